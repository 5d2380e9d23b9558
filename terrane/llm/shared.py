"""What the operators share: the documents table and cuts in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import cut, delete, discard, scratch, shared_dir

__all__ = ["cut", "delete", "discard", "documents", "no_clash", "scratch", "shared_dir"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def no_clash(keep: list[str], added: list[str]) -> None:
    """Kept columns must have names of their own; Spark tells them apart without case."""
    if clash := {c.lower() for c in keep} & {c.lower() for c in added}:
        raise ValueError(f"kept columns named like added ones: {sorted(clash)}")
