"""Lineage cuts: tables written to the folder that the whole cluster shares.

A written table is read back with fresh size estimates.  (Checkpointed plans keep the
estimates of the plan behind them, which multiply from join to join in loops.)  The
shuffle files of the plan behind a cut go when it is written; the cuts themselves go
with :func:`discard`, or at the end of a :func:`scratch` block around them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then deletes a plan's shuffle files when the plan is done.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Where none is named, one machine gets a temporary folder and a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terrane-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder, with no lineage behind them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind a cut that no later plan reads."""
    delete(df.sparkSession, df._cut_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete every cut made inside once the block ends; results must be written or collected by then."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            delete(spark, path)
