"""Supervoxels, whole-graph measures, further selectors, effect sizes and censored scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import cluster, graphs, images, models, reliability, selection, spatial, supervoxels, survival, texture
from .inputs import CELLS, FEATURES, SESSIONS, SURVIVAL, cells, predictions, rounded, sessions, table
from .inputs import survival as outcomes
from .modelling import _E, _points
from .spatial import _CENTROID_EDGES, _CENTRES, _blocks
from .texture import _levels

X = ("l_quantity", "l_extendedprice", "l_tax")


def _supervoxel(name: str, k: int, **options):
    register(f"supervoxel_{name}")(lambda spark, sf_dir: supervoxels.label(cells(spark, sf_dir), "subject", ("price", "tax"), name, k, **options))


_supervoxel("kmeans", 8, n_init=2)
_supervoxel("gmm", 4, max_iter=20)
_supervoxel("slic", 12)


@register("label_cleanup")
def label_cleanup(spark, sf_dir):
    return supervoxels.drop_small(cells(spark, sf_dir), "subject", 3)


@register("voxel_units", f"WITH {CELLS} SELECT subject, z, y, x, row_number() OVER (PARTITION BY subject ORDER BY z, y, x) AS unit FROM cells")
def voxel_units(spark, sf_dir):
    from pyspark.sql import Window

    at = Window.partitionBy("subject").orderBy("z", "y", "x")
    return cells(spark, sf_dir).select("subject", "z", "y", "x", F.row_number().over(at).cast("long").alias("unit"))


@register(
    "voxel_raw_pivot",
    "SELECT l_suppkey AS subject, l_linenumber AS z, max(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END) AS \"A\", max(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS \"N\", max(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END) AS \"R\" FROM lineitem GROUP BY ALL",
)
def voxel_raw_pivot(spark, sf_dir):
    """Modalities, one row each, as columns of a voxel."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("z"), "l_returnflag", "l_extendedprice")
    return i.groupBy("subject", "z").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_extendedprice"))


def _graph(spark, sf_dir):
    nodes = spatial.centroids(_blocks(spark, sf_dir), "subject", "node")
    return nodes, spatial.centroid_edges(nodes, "subject", 3.0)


@register("graph_topology")
def graph_topology(spark, sf_dir):
    return graphs.by_subject(*_graph(spark, sf_dir), "subject", more=True)


@register("graph_null_model")
def graph_null_model(spark, sf_dir):
    return graphs.by_subject(*_graph(spark, sf_dir), "subject", null_rounds=5).select("subject", "clustering", "clustering_null_z")


@register("graph_spatial_dispersion", f"WITH {_CENTRES} SELECT subject, round((stddev_pop(z) + stddev_pop(y) + stddev_pop(x)) / 3, 6) AS spatial_dispersion FROM c GROUP BY 1")
def graph_spatial_dispersion(spark, sf_dir):
    return rounded(graphs.dispersion(_graph(spark, sf_dir)[0], "subject"))


@register("graph_clark_evans", f"WITH {_CENTRES}, d AS (SELECT a.subject, a.node, min(sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM c a JOIN c b ON a.subject = b.subject AND a.node <> b.node GROUP BY ALL), v AS (SELECT subject, count(*) AS v FROM cells GROUP BY 1) SELECT subject, round(avg(d) / (0.5539602785::DOUBLE / pow(count(*) / any_value(v), 1.0::DOUBLE / 3)), 6) AS clark_evans FROM d JOIN v USING (subject) GROUP BY 1")
def graph_clark_evans(spark, sf_dir):
    return rounded(graphs.clark_evans(_graph(spark, sf_dir)[0], cells(spark, sf_dir), "subject"))


@register("graph_cross_degree", f"WITH {_CENTROID_EDGES}, b AS (SELECT subject, src AS node, dst AS other FROM e UNION ALL SELECT subject, dst, src FROM e), m AS (SELECT subject, node // 10000 AS a, other // 10000 AS b, count(*) AS edges, count(DISTINCT node) AS linked FROM b WHERE node // 10000 <> other // 10000 GROUP BY ALL), na AS (SELECT subject, node // 10000 AS a, count(*) AS nodes_a FROM c GROUP BY ALL) SELECT subject, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, edges, nodes_a, nodes_a - linked AS isolated_a FROM m JOIN na USING (subject, a)")
def graph_cross_degree(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graphs.cross_degree(nodes.withColumn("label", F.floor(F.col("node") / 10000).cast("int")), edges, "subject")


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), *FEATURES)


@register("select_univariate_logistic")
def select_univariate_logistic(spark, sf_dir):
    fit = selection.logistic_wald(_rows(spark, sf_dir), X, "y")
    return spark.createDataFrame([(f, v["coef"], v["se"], v["p"]) for f, v in fit.items()], "feature string, coef double, se double, p double")


@register("select_statistical_test")
def select_statistical_test(spark, sf_dir):
    return spark.createDataFrame([(r["feature"], r["test"], r["statistic"], r["p"]) for r in selection.statistical_test(_rows(spark, sf_dir), X, "y")], "feature string, test string, statistic double, p double")


@register("select_stepwise")
def select_stepwise(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in selection.stepwise(_rows(spark, sf_dir), X, "y", "backward")], "feature string")


@register("select_lasso")
def select_lasso(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in selection.lasso(_rows(spark, sf_dir).withColumn("y", F.col("y").cast("double")), X, "y", folds=3, n_alphas=3)], "feature string")


@register("select_recursive_elimination")
def select_recursive_elimination(spark, sf_dir):
    return spark.createDataFrame([(f,) for f in selection.eliminate(_rows(spark, sf_dir), X, "y", folds=2)], "feature string")


_TWO = f"{SESSIONS}, t AS (SELECT subject, session, value, CAST(session = 1 AS INTEGER) AS grp FROM sessions WHERE session <= 2)"


def _two(spark, sf_dir):
    return sessions(spark, sf_dir).where("session <= 2").withColumn("grp", (F.col("session") == 1).cast("int"))


@register("effect_cliffs_unpaired", f"WITH {_TWO} SELECT round(avg(sign(a.value - b.value)), 6) AS delta FROM t a JOIN t b ON a.grp = 1 AND b.grp = 0")
def effect_cliffs_unpaired(spark, sf_dir):
    return rounded(reliability.cliffs_delta(_two(spark, sf_dir), "value", "grp"))


@register("effect_cohens_pooled", f"WITH {_TWO} SELECT round((avg(value) FILTER (grp = 1) - avg(value) FILTER (grp = 0)) / sqrt(((count(*) FILTER (grp = 1) - 1) * var_samp(value) FILTER (grp = 1) + (count(*) FILTER (grp = 0) - 1) * var_samp(value) FILTER (grp = 0)) / (count(*) - 2)), 6) AS d FROM t")
def effect_cohens_pooled(spark, sf_dir):
    return rounded(reliability.cohens_d(_two(spark, sf_dir), "value", "grp"))


@register("test_wilcoxon", f"WITH {SESSIONS}, d AS (SELECT a.value - b.value AS d FROM sessions a JOIN sessions b USING (subject) WHERE a.session = 1 AND b.session = 2 AND a.value <> b.value), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS k FROM d) SELECT CAST(sum(k) FILTER (d > 0) AS DOUBLE) AS w FROM r")
def test_wilcoxon(spark, sf_dir):
    wide = sessions(spark, sf_dir).where("session <= 2").groupBy("subject").pivot("session", [1, 2]).agg(F.first("value"))
    return spark.createDataFrame([(float(reliability.wilcoxon(wide, "1", "2")["w"]),)], "w double")


@register("retest_mapping")
def retest_mapping(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").withColumn("habitat", (1 + F.col("l_quantity").cast("int") % 3).cast("int"))
    return reliability.retest_mapping(i.where("l_linestatus = 'F'"), i.where("l_linestatus <> 'F'"), "habitat", ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@register("precise_features", "SELECT p_brand AS feature FROM part GROUP BY 1 HAVING bool_and(p_size >= 1) AND min(p_retailprice) >= 900")
def precise_features(spark, sf_dir):
    """Brands that pass in each of two experiments, taken as features."""
    p = table(spark, sf_dir, "part")
    one = p.select(F.lit("size").alias("experiment"), F.col("p_brand").alias("feature"), (F.col("p_size") >= 1).cast("double").alias("lcl"))
    two = p.groupBy("p_brand").agg(F.min("p_retailprice").alias("m")).select(F.lit("price").alias("experiment"), F.col("p_brand").alias("feature"), (F.col("m") >= 900).cast("double").alias("lcl"))
    return reliability.precise_features(one.union(two), 0.5)


_GRID = (200.0, 600.0, 1000.0, 1400.0)


@register("survival_censoring", f"WITH {SURVIVAL}, k AS (SELECT time, sum(1 - event) AS d, count(*) AS n FROM survival GROUP BY 1), r AS (SELECT time, d, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM k) SELECT time, round(s, 6) AS g FROM (SELECT *, product(1 - d / at_risk) OVER (ORDER BY time) AS s FROM r) WHERE d > 0")
def survival_censoring(spark, sf_dir):
    return rounded(survival.censoring(outcomes(spark, sf_dir)))


_G = f"""WITH {SURVIVAL}, k AS (SELECT time, sum(1 - event) AS d, count(*) AS n FROM survival GROUP BY 1), r AS (SELECT time, d, sum(n) OVER (ORDER BY time DESC) AS at_risk FROM k), g AS (SELECT time, s AS g FROM (SELECT *, product(1 - d / at_risk) OVER (ORDER BY time) AS s FROM r) WHERE d > 0),
w AS (SELECT s.*, coalesce((SELECT arg_max(g, g.time) FROM g WHERE g.time < s.time), 1.0) AS gi FROM survival s), t AS (SELECT unnest([200.0::DOUBLE, 600.0, 1000.0, 1400.0]) AS t), tt AS (SELECT t, coalesce((SELECT arg_max(g, g.time) FROM g WHERE g.time <= t), 1.0) AS gt FROM t)"""


@register("survival_brier", f"{_G}, p AS (SELECT *, exp(-t / 1000.0::DOUBLE) AS p FROM w, tt) SELECT t, round(avg(CASE WHEN time <= t AND event = 1 THEN p * p / gi WHEN time > t THEN (1 - p) ** 2 / gt ELSE 0 END), 6) AS brier FROM p GROUP BY 1")
def survival_brier(spark, sf_dir):
    df = outcomes(spark, sf_dir).withColumn("p", F.array(*(F.exp(F.lit(-t / 1000)) for t in _GRID)))
    return rounded(survival.brier_curve(df, "p", _GRID))


@register("survival_dynamic_auc", f"{_G} SELECT t, round(sum(CASE WHEN a.risk > b.risk THEN 1 / a.gi WHEN a.risk = b.risk THEN 0.5 / a.gi ELSE 0 END) / (SELECT sum(1 / c.gi) FROM w c WHERE c.time <= t AND c.event = 1) / (SELECT count(*) FROM w d WHERE d.time > t), 6) AS auc FROM t, w a, w b WHERE a.time <= t AND a.event = 1 AND b.time > t GROUP BY t")
def survival_dynamic_auc(spark, sf_dir):
    return rounded(survival.dynamic_auc(outcomes(spark, sf_dir), _GRID))


@register("image_quarter_turn", f"WITH {CELLS}, b AS (SELECT subject, max(y) + min(y) AS my, max(x) + min(x) AS mx FROM cells GROUP BY 1) SELECT a.subject, a.z, a.y, a.x, round(coalesce(c.tax, 0.0), 6) AS tax FROM cells a JOIN b USING (subject) LEFT JOIN cells c ON c.subject = a.subject AND c.z = a.z AND 2 * c.y = my + (2 * a.x - mx) AND 2 * c.x = mx - (2 * a.y - my)")
def image_quarter_turn(spark, sf_dir):
    return rounded(images.rigid(cells(spark, sf_dir), ("subject",), "tax", 90.0))


@register("image_rigid")
def image_rigid(spark, sf_dir):
    return rounded(images.rigid(cells(spark, sf_dir), ("subject",), "tax", 0.5, (0.0, 0.25, 0.5)))


@register("cluster_silhouette")
def cluster_silhouette(spark, sf_dir):
    return spark.createDataFrame([(cluster.silhouette(_points(spark, sf_dir), _E, "label", "vec_id"),)], "silhouette double")


@register("model_classifier_adaboost")
def model_classifier_adaboost(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return models.adaboost(rows.where("split = 'train'"), rows.where("split = 'test'"), ("p", "p2"), "y", rounds=5).select("id", "prob")


@register("texture_glcm_mcc")
def texture_glcm_mcc(spark, sf_dir):
    return texture.features(_levels(spark, sf_dir), ["subject"], "mcc")
