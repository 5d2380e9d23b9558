"""Table joins, merges, panels, sets, splits and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import tables
from .inputs import rounded, table


def _by_customer(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("long").alias("n"))


_A = "a AS (SELECT o_custkey AS id, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1)"
_B = "b AS (SELECT c_custkey AS id, c_acctbal AS balance, CAST(c_nationkey AS BIGINT) AS n FROM customer)"


@register("join_feature_tables", f"WITH {_A}, {_B} SELECT id, a.n, top, balance FROM a JOIN b USING (id)")
def join_feature_tables(spark, sf_dir):
    return tables.join_one_to_one(_by_customer(spark, sf_dir), _customers(spark, sf_dir).drop("n"), ("id",))


@register("merge_tables_inner", f"WITH {_A}, {_B} SELECT id, a.n, top, balance, b.n AS n__account FROM a JOIN b USING (id)")
def merge_tables_inner(spark, sf_dir):
    return tables.merge({"orders": _by_customer(spark, sf_dir), "account": _customers(spark, sf_dir)}, ("id",))


@register("merge_tables_outer", f"WITH {_A}, {_B} SELECT id, a.n, top, balance, b.n AS n__account FROM a FULL JOIN (SELECT * FROM b WHERE balance > 0) b USING (id)")
def merge_tables_outer(spark, sf_dir):
    return tables.merge({"orders": _by_customer(spark, sf_dir), "account": _customers(spark, sf_dir).where("balance > 0")}, ("id",), "outer")


@register("load_feature_table", f"WITH {_A}, {_B}, c AS (SELECT id, n AS label, top FROM a WHERE n >= 9), d AS (SELECT id, n AS label, balance FROM b) SELECT id, top AS orders_top, balance AS account_balance, coalesce(c.label, d.label) AS label FROM c FULL JOIN d USING (id)")
def load_feature_table(spark, sf_dir):
    a = _by_customer(spark, sf_dir).where("n >= 9").withColumnRenamed("n", "label")
    return tables.load_feature_table({"orders": a, "account": _customers(spark, sf_dir).withColumnRenamed("n", "label")}, "id", "label")


_P = "p AS (SELECT doc_id AS subject_id, quality AS label, toxic, (doc_id * 13 % 101) / 101.0::DOUBLE AS prob FROM labels)"


@register("merge_predictions", f"WITH {_P}, a AS (SELECT subject_id, label, round(prob, 6) AS first_prob FROM p WHERE toxic = 0), b AS (SELECT subject_id, label, round(1 - prob, 6) AS second_prob FROM p WHERE label = 1) SELECT subject_id, label, first_prob, second_prob FROM a FULL JOIN b USING (subject_id, label)")
def merge_predictions(spark, sf_dir):
    p = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("subject_id"), F.col("quality").alias("label"), "toxic", (F.col("doc_id") * 13 % 101 / 101.0).alias("prob"))
    return rounded(tables.merge_predictions({"first": p.where("toxic = 0"), "second": p.where("label = 1").withColumn("prob", 1 - F.col("prob"))}))


@register("select_rows_by_id", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_custkey IN (SELECT o_custkey FROM orders))")
def select_rows_by_id(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    known = orders.select("o_custkey").distinct()
    ids = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")).join(known, "o_custkey", "left_semi")
    return tables.select_ids(orders, ids, "o_custkey")


@register("stack_rows", "SELECT c_custkey AS id, c_acctbal AS balance, NULL AS size FROM customer UNION ALL SELECT p_partkey, NULL, p_size FROM part")
def stack_rows(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return tables.stack([a, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))])


@register("common_ids", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders INTERSECT SELECT s_suppkey FROM supplier")
def common_ids(spark, sf_dir):
    frames = [table(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("customer", "c_custkey"), ("orders", "o_custkey"), ("supplier", "s_suppkey"))]
    return tables.common_ids(frames, "id")


@register("stable_in_every_group", "SELECT l_partkey FROM lineitem WHERE l_quantity >= 10 GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3 EXCEPT SELECT p_partkey FROM part WHERE p_size < 5")
def stable_in_every_group(spark, sf_dir):
    kept = table(spark, sf_dir, "lineitem").where("l_quantity >= 10").groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("g")).where("g = 3").select("l_partkey")
    return kept.exceptAll(table(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey")))


def _wide(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").withColumn("k", (1 + F.col("l_quantity").cast("int") % 3).cast("int"))
    cols = [F.max(F.when((F.col("k") == k) & (F.col("l_linenumber") <= 4), F.col(c))).alias(f"habitat_{k}_{n}") for k in (1, 2, 3) for c, n in (("l_extendedprice", "price"), ("l_tax", "tax"))]
    return i.groupBy(F.col("l_orderkey").alias("subject")).agg(*cols)


_PANEL = "panel AS (SELECT l_orderkey AS subject, CAST(1 + CAST(floor(l_quantity) AS INTEGER) % 3 AS INTEGER) AS habitat, f AS feature, max(CASE WHEN f = 'price' THEN l_extendedprice ELSE l_tax END) AS value FROM lineitem, (SELECT unnest(['price', 'tax']) AS f) WHERE l_linenumber <= 4 GROUP BY ALL)"


@register("habitat_panel", f"WITH {_PANEL} SELECT subject, habitat, feature, round(value, 6) AS value FROM panel")
def habitat_panel(spark, sf_dir):
    return rounded(tables.melt(_wide(spark, sf_dir), ("subject",)))


@register("habitat_summary", f"WITH {_PANEL} SELECT habitat, feature, count(*) AS n, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.75), 5) AS q75 FROM panel GROUP BY ALL")
def habitat_summary(spark, sf_dir):
    return rounded(tables.summary(tables.melt(_wide(spark, sf_dir), ("subject",))), 5)


@register("habitat_contrasts", f"WITH {_PANEL} SELECT a.feature, a.habitat AS habitat_a, b.habitat AS habitat_b, count(*) AS n, round(avg(a.value - b.value), 5) AS mean_diff, round(avg(sign(a.value - b.value)), 5) AS cliffs_delta, round(avg(a.value - b.value) / stddev_samp(a.value - b.value), 5) AS cohens_d FROM panel a JOIN panel b ON a.subject = b.subject AND a.feature = b.feature AND a.habitat < b.habitat GROUP BY ALL")
def habitat_contrasts(spark, sf_dir):
    return rounded(tables.contrasts(tables.melt(_wide(spark, sf_dir), ("subject",)), "subject"), 5)


@register("split_holdout_sizes", "SELECT quality, CAST(ceil(count(*) * 0.3) AS BIGINT) AS n_test, count(*) - CAST(ceil(count(*) * 0.3) AS BIGINT) AS n_train FROM labels GROUP BY 1")
def split_holdout_sizes(spark, sf_dir):
    df = tables.split(table(spark, sf_dir, "labels"), "doc_id", 0.3, ("quality",))
    return df.groupBy("quality").agg(F.count_if(F.col("split") == "test").alias("n_test"), F.count_if(F.col("split") == "train").alias("n_train"))


@register("split_fold_sizes", "SELECT quality, f AS fold, CAST(floor((c + 4 - f) / 5) AS BIGINT) AS n FROM (SELECT quality, count(*) AS c FROM labels GROUP BY 1), (SELECT unnest([0, 1, 2, 3, 4]) AS f)")
def split_fold_sizes(spark, sf_dir):
    return tables.folds(table(spark, sf_dir, "labels"), "doc_id", 5, ("quality",)).groupBy("quality", "fold").agg(F.count("*").alias("n"))


@register("resample_over", "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, (SELECT max(n) FROM c) AS n FROM c")
def resample_over(spark, sf_dir):
    return tables.resample(table(spark, sf_dir, "labels"), "toxic", "doc_id").groupBy("toxic").agg(F.count("*").alias("n"))


@register("resample_under", "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, (SELECT min(n) FROM c) AS n FROM c")
def resample_under(spark, sf_dir):
    return tables.resample(table(spark, sf_dir, "labels"), "toxic", "doc_id", "random_under").groupBy("toxic").agg(F.count("*").alias("n"))


_VOTES = "v AS (SELECT doc_id AS id, f, (doc_id * (7 + f) % 89) / 89.0::DOUBLE AS prob FROM labels, (SELECT unnest([0, 1, 2]) AS f))"


def _votes(spark, sf_dir):
    f = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), f.alias("f")).withColumn("prob", F.col("id") * (7 + F.col("f")) % 89 / 89.0)


@register("ensemble_soft", f"WITH {_VOTES} SELECT id, round(avg(prob), 6) AS prob FROM v GROUP BY 1")
def ensemble_soft(spark, sf_dir):
    return rounded(tables.ensemble(_votes(spark, sf_dir), "id", "prob"))


@register("ensemble_hard", f"WITH {_VOTES} SELECT id, round(avg((prob >= 0.5)::INT), 6) AS prob FROM v GROUP BY 1")
def ensemble_hard(spark, sf_dir):
    return rounded(tables.ensemble(_votes(spark, sf_dir), "id", "prob", "hard"))


@register("first_per_group", "SELECT host, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages) GROUP BY 1")
def first_per_group(spark, sf_dir):
    """One file of each series: the first by id of each host."""
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).agg(F.min("page_id").alias("page_id"))


@register("tag_table", "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS series, count(*) AS n, min(regexp_extract(html, '<title>([^<]*)', 1)) AS first_title, max(length(html)) AS largest FROM pages GROUP BY 1")
def tag_table(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("series")).agg(F.count("*").alias("n"), F.min(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("first_title"), F.max(F.length("html")).cast("long").alias("largest"))
