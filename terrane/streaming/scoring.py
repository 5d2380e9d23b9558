"""Incremental scoring: units that arrive later get the regions of a fitted study.

The study's cohort state and centroids are constants of the plan, so scoring a row
needs no state and no shuffle; sizes by time window are kept under a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import cluster, prep


def read_units(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def score(stream: DataFrame, chain: prep.Chain, features: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """The rows with ``habitat``; the chain must have been fitted over the cohort."""
    if chain.by:
        raise ValueError("a chain by subject needs the whole subject; fit it over the cohort")
    return cluster.nearest(chain.transform(stream), features, centroids)


def sizes(scored: DataFrame, time: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, habitat, n) of tumbling windows; rows later than the watermark are left out."""
    return scored.withWatermark(time, late).groupBy(F.window(time, window), "habitat").agg(F.count("*").alias("n"))


def write(df: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the rows to a Parquet folder; a restart goes on where the checkpoint ended, without repeats."""
    writer = df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
