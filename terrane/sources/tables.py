"""Feature tables on disk: several CSV files as one table, units tables, feature families, manifests."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import load_feature_table, merge


def read_csv(spark: SparkSession, path: str, id_column: str | None = None, separator: str = ",") -> DataFrame:
    """A CSV file with a header; the id column is text whatever it looks like."""
    df = spark.read.option("header", "true").option("inferSchema", "true").option("sep", separator).csv(path)
    if not id_column:
        return df
    raw = spark.read.option("header", "true").option("sep", separator).csv(path)
    kinds = dict(df.dtypes)
    return raw.select(*(F.col(f"`{c}`") if c == id_column else F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in raw.columns))


def read_feature_files(spark: SparkSession, sources: Sequence[Mapping], id_column: str, label: str | None = None) -> DataFrame:
    """Full outer join of CSV files given as {path, name, features?}; unknown features raise."""
    frames = {}
    for s in sources:
        df = read_csv(spark, s["path"], id_column)
        if wanted := s.get("features"):
            if unknown := [c for c in wanted if c not in df.columns]:
                raise ValueError(f"{s['path']} has no {unknown}")
            df = df.select(id_column, *wanted, *([label] if label and label in df.columns else []))
        frames[s["name"]] = df
    return load_feature_table(frames, id_column, label)


def merge_files(spark: SparkSession, paths: Sequence[str], ids: Sequence[str] | None = None, how: str = "inner", separator: str = ",") -> DataFrame:
    """Join CSV files on their first column or the given ones; clashing names get the file's stem behind them."""
    frames = {PurePosixPath(p).stem: read_csv(spark, p, separator=separator) for p in paths}
    keys = list(ids) if ids else [next(iter(frames.values())).columns[0]]
    return merge(frames, keys, how)


def read_times(spark: SparkSession, path: str, subject: str = "Name", time_format: str = "HH-mm-ss") -> DataFrame:
    """(subject, phase, time) of a table with one column of acquisition times a phase."""
    df = read_csv(spark, path, subject)
    phases = [c for c in df.columns if c != subject]
    long = df.select(F.col(subject).alias("subject"), *(F.col(c).cast("string") for c in phases)).unpivot(["subject"], phases, "phase", "time")
    return long.withColumn("time", F.to_timestamp("time", time_format))


def read_units(spark: SparkSession, folder: str) -> DataFrame:
    """A units table, Parquet before CSV."""
    for name, read in (("habitats.parquet", spark.read.parquet), ("habitats.csv", lambda p: spark.read.option("header", "true").option("inferSchema", "true").csv(p))):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return read(f"{folder}/{name}")
    raise FileNotFoundError(f"no units table in {folder}")


def write_units(df: DataFrame, folder: str, file_format: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", "true").csv(f"{folder}/habitats.csv")
    elif file_format == "parquet":
        writer.parquet(f"{folder}/habitats.parquet")
    else:
        raise ValueError(f"unknown format {file_format}")


def write_families(families: Mapping[str, DataFrame], folder: str) -> None:
    """One CSV folder a feature family; a family with a ``habitat`` column is split by it."""
    for name, df in families.items():
        writer = df.write.mode("overwrite").option("header", "true")
        (writer.partitionBy("habitat") if "habitat" in df.columns else writer).csv(f"{folder}/{name}")


def write_manifest(spark: SparkSession, path: str, spec: Mapping, outcomes: Mapping[str, str], versions: Mapping[str, str]) -> None:
    """A run's specification, outcomes and versions as one line of JSON."""
    row = json.dumps({"spec": spec, "outcomes": outcomes, "versions": versions}, sort_keys=True, default=str)
    spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(path)
