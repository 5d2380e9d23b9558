"""How the driver's tables stand in for units, label maps, predictions and repeat sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as units of a supplier."""
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", *FEATURES)


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with missing, NaN and infinite prices put in."""
    n = F.col("l_linenumber")
    price = F.when(n == 7, F.lit(None)).when(n == 6, F.lit(float("nan"))).when(n == 5, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    return units(spark, sf_dir).withColumn("l_extendedprice", price)


#: The same holes in SQL: all three kinds are missing values.
HOLED = "(SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, CASE WHEN l_linenumber >= 5 THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM lineitem)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label map per supplier: subject, z, y, x, label 1 to 3 and two intensities."""
    rows = table(spark, sf_dir, "lineitem")
    x = F.pmod(F.floor("l_extendedprice").cast("long"), F.lit(12)).cast("int")
    placed = rows.select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").cast("int").alias("z"), F.pmod("l_partkey", F.lit(12)).cast("int").alias("y"), x.alias("x"), "l_quantity", "l_extendedprice", "l_tax")
    return placed.groupBy("subject", "z", "y", "x").agg((1 + F.min(F.col("l_quantity").cast("int")) % 3).cast("int").alias("label"), F.max("l_extendedprice").alias("price"), F.max("l_tax").alias("tax"))


CELLS = """cells AS (
  SELECT l_suppkey AS subject, CAST(l_linenumber AS INTEGER) AS z, CAST(l_partkey % 12 AS INTEGER) AS y, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 12 AS INTEGER) AS x,
    CAST(1 + min(CAST(floor(l_quantity) AS INTEGER)) % 3 AS INTEGER) AS label, max(l_extendedprice) AS price, max(l_tax) AS tax
  FROM lineitem GROUP BY 1, 2, 3, 4)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split, y, toxic, p, p2): labelled documents, with two scores made of their lengths and sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    labels = table(spark, sf_dir, "labels")
    p = F.round(1 / (1 + F.exp(-(F.ln(F.col("n_chars") + 1.0) - 7.2))), 4)
    p2 = F.round((F.pmod(F.col("doc_id") * 37 + F.col("n_chars"), F.lit(1000)) + 0.5) / 1000 * 0.6 + p * 0.4, 4)
    split = F.when(F.pmod("doc_id", F.lit(3)) == 0, "test").otherwise("train")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), split.alias("split"), F.col("quality").cast("int").alias("y"), F.col("toxic").cast("int").alias("toxic"), p.alias("p"), p2.alias("p2"))


PREDICTIONS = """predictions AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, CAST(quality AS INTEGER) AS y, CAST(toxic AS INTEGER) AS toxic,
    round(1 / (1 + exp(-(ln(n_chars + 1.0::DOUBLE) - 7.2::DOUBLE))), 4) AS p,
    round((((doc_id * 37 + n_chars) % 1000) + 0.5::DOUBLE) / 1000 * 0.6::DOUBLE + round(1 / (1 + exp(-(ln(n_chars + 1.0::DOUBLE) - 7.2::DOUBLE))), 4) * 0.4::DOUBLE, 4) AS p2
  FROM labels JOIN documents USING (doc_id))"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, session 1 to 3, value): the first three orders of customers that have as many."""
    from pyspark.sql import Window

    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    every = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").withColumn("session", F.row_number().over(order)).withColumn("n", F.count("*").over(every))
    return rows.where("n >= 3 and session <= 3").select(F.col("o_custkey").alias("subject"), "session", F.col("o_totalprice").alias("value"))


SESSIONS = """sessions AS (
  SELECT o_custkey AS subject, session, o_totalprice AS value FROM (
    SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS session, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
  WHERE n >= 3 AND session <= 3)"""


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, time in days, event, risk): customers from their first to their last order.

    Prices are added in the order of their keys, so a mean beside a half is rounded the same way however rows are dealt to tasks.
    """
    from pyspark.sql import Window

    upto = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    o = table(spark, sf_dir, "orders").withColumn("__sum", F.sum("o_totalprice").over(upto))
    mean = F.max_by("__sum", "o_orderkey") / F.count("o_totalprice")
    last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    days = F.date_diff(F.max("o_orderdate"), F.min("o_orderdate"))
    return o.groupBy(F.col("o_custkey").alias("subject")).agg(days.cast("int").alias("time"), (last == "F").cast("int").alias("event"), F.round(mean, 0).alias("risk"))


SURVIVAL = """survival AS (
  SELECT o_custkey AS subject, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INTEGER) AS time,
    CAST(arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) = 'F' AS INTEGER) AS event, round(avg(o_totalprice), 0) AS risk
  FROM orders GROUP BY 1)"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """The rows with every double rounded, so that summation order does not show."""
    return df.select(*(F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))
