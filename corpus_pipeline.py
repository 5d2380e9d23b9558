"""The corpus pipeline: five stages from raw documents to piece ids.

Every stage reads what the one before it kept, as a table written in the shared
folder, so a lost executor costs a stage's tasks and never the chain.

All stages: columns other than those of documents are not read, an empty table gives an
empty table, texts of any length are read whole, and rows are told apart by a 64-bit
hash of id and text (:func:`row_key`), so nulls and repeats in ``doc_id`` mix nothing up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, langid, pieces, pii, simhash
from terrane.llm.queries import vocabulary
from terrane.llm.shared import delete, documents, scratch, shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document with no language of at least this share is no document of any language.
MIN_SHARE = 0.4


def row_key() -> Column:
    """Tells rows apart by id and text; equal rows are one."""
    return F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a determined language; a mixture goes only if no language has MIN_SHARE of it.

    Null texts and texts without a letter have no language and go, and so does everything
    if no row has a language to learn from.  All rows with an id, a text and a language
    teach.  Null ids and repeated rows stay as they are.
    """
    model = langid.fit(docs, per_language=None)
    rated = langid.identify(docs, model, keep=[*COLUMNS])
    return rated.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group: the one with the smallest id (null last), of equal ids one by its row key.

    Null and empty texts are one group.  Equal rows are one.
    """
    keyed = docs.withColumn("row_key", row_key())
    found = simhash.near_duplicates(keyed, id_col="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_key"))
    kept = keyed.select("row_key", "doc_id").distinct().join(found, "row_key").groupBy("component_id").agg(F.min(order)["row_key"].alias("row_key")).select("row_key")
    left = keyed.join(kept, "row_key", "left_semi")
    if not keyed.groupBy("row_key").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["row_key"])
    return left.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows whose own text contains a benchmark item.

    A clean row stays if another one without an id, or with the same id, goes; equal
    rows go or stay together.  Null and empty texts stay.
    """
    keyed = docs.withColumn("row_key", row_key())
    leaks = decontaminate.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row_key").select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put each identifier's kind in its place; ``n_chars`` counts the new text.

    Every row stays, null ids and repeated rows too; a null text stays null and so does
    its ``n_chars``.
    """
    found = pii.scan(docs, keep=["doc_id", "lang", "source"])
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, n_byte_tokens, round_trip of every row; null and empty texts have no ids."""
    return pieces.encode(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: Language models, latent retrieval and merge ranks have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's table and cuts go when the next one is written."""
    docs = documents(spark, sf_dir).select(*COLUMNS)
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:
            delete(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
