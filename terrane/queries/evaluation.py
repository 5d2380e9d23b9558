"""Metrics, thresholds, calibration, AUC comparison, reliability and effect sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import metrics, reliability
from .inputs import PREDICTIONS, SESSIONS, predictions, rounded, sessions, table



def _panel_sql(source: str, by: str = "", tp="tp", fp="fp", tn="tn", fn="fn") -> str:
    sens, ppv = f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)"
    return f"""round(coalesce(({tp} + {tn}) / nullif({tp} + {fp} + {tn} + {fn}, 0), 0), 6) AS accuracy, round({sens}, 6) AS sensitivity, round(coalesce({tn} / nullif({tn} + {fp}, 0), 0), 6) AS specificity, round({ppv}, 6) AS ppv, round(coalesce({tn} / nullif({tn} + {fn}, 0), 0), 6) AS npv,
  round(coalesce(2 * {ppv} * {sens} / nullif({ppv} + {sens}, 0), 0), 6) AS f1_score"""


_COUNTS = "CAST(count(*) FILTER (y = 1 AND p >= {t}) AS DOUBLE) AS tp, CAST(count(*) FILTER (y <> 1 AND p >= {t}) AS DOUBLE) AS fp, CAST(count(*) FILTER (y <> 1 AND p < {t}) AS DOUBLE) AS tn, CAST(count(*) FILTER (y = 1 AND p < {t}) AS DOUBLE) AS fn"


@register("metric_confusion_matrix", f"WITH {PREDICTIONS} SELECT split, y, CAST(p >= 0.5 AS INTEGER) AS y_hat, count(*) AS n FROM predictions GROUP BY ALL")
def metric_confusion_matrix(spark, sf_dir):
    return metrics.confusion(metrics.clean(predictions(spark, sf_dir), "y", "p"), "y", "y_hat", ("split",))


@register("metric_panel", f"WITH {PREDICTIONS}, c AS (SELECT split, {_COUNTS.format(t=0.5)} FROM predictions GROUP BY 1) SELECT split, {_panel_sql('c')} FROM c")
def metric_panel(spark, sf_dir):
    return rounded(metrics.at_threshold(predictions(spark, sf_dir), "y", "p", 0.5, ("split",)))


@register("metric_auc", f"WITH {PREDICTIONS}, r AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0 AS r FROM predictions) SELECT split, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc FROM r GROUP BY 1")
def metric_auc(spark, sf_dir):
    return rounded(metrics.auc(predictions(spark, sf_dir), "y", "p", ("split",)))


_CURVE = f"""WITH {PREDICTIONS}, k AS (SELECT split, p AS threshold, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM predictions GROUP BY ALL),
curve AS (SELECT split, threshold, CAST(sum(a) OVER w AS BIGINT) AS tp, CAST(sum(b) OVER w AS BIGINT) AS fp, CAST(sum(b) OVER g - sum(b) OVER w AS BIGINT) AS tn, CAST(sum(a) OVER g - sum(a) OVER w AS BIGINT) AS fn FROM k WINDOW w AS (PARTITION BY split ORDER BY threshold DESC), g AS (PARTITION BY split))"""


@register("metric_roc_curve", f"{_CURVE} SELECT split, threshold, tp, fp, tn, fn FROM curve")
def metric_roc_curve(spark, sf_dir):
    return metrics.curve(predictions(spark, sf_dir), "y", "p", ("split",))


_YOUDEN = f"{_CURVE}, j AS (SELECT split, threshold, tp / (tp + fn) + tn / (tn + fp) - 1 AS youden FROM curve), best AS (SELECT split, threshold, youden FROM j QUALIFY row_number() OVER (PARTITION BY split ORDER BY youden DESC, threshold DESC) = 1)"


@register("threshold_youden", f"{_YOUDEN} SELECT split, threshold, round(youden, 6) AS youden FROM best")
def threshold_youden(spark, sf_dir):
    return rounded(metrics.youden(predictions(spark, sf_dir), "y", "p", ("split",)))


@register("threshold_transfer", f"{_YOUDEN}, c AS (SELECT {_COUNTS.format(t='(SELECT threshold FROM best WHERE split = ' + chr(39) + 'train' + chr(39) + ')')} FROM predictions WHERE split = 'test') SELECT {_panel_sql('c')} FROM c")
def threshold_transfer(spark, sf_dir):
    """The training split's cut, replayed on the test split."""
    df = predictions(spark, sf_dir)
    cut = metrics.youden(df.where("split = 'train'"), "y", "p").first()["threshold"]
    return rounded(metrics.at_threshold(df.where("split = 'test'"), "y", "p", cut))


_TARGET = f"{_CURVE}, t AS (SELECT split, threshold, {_panel_sql('curve')} FROM curve)"


@register("threshold_targets", f"{_TARGET} SELECT * FROM t WHERE sensitivity >= 0.5 AND specificity >= 0.4")
def threshold_targets(spark, sf_dir):
    return rounded(metrics.meeting_targets(predictions(spark, sf_dir), "y", "p", {"sensitivity": 0.5, "specificity": 0.4}, ("split",)))


@register("threshold_pareto", f"{_TARGET}, m AS (SELECT * FROM t WHERE sensitivity >= 0.5 AND specificity >= 0.4) SELECT a.split, a.threshold FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.split = a.split AND b.sensitivity >= a.sensitivity AND b.specificity >= a.specificity AND b.ppv >= a.ppv AND b.npv >= a.npv AND (b.sensitivity > a.sensitivity OR b.specificity > a.specificity OR b.ppv > a.ppv OR b.npv > a.npv))")
def threshold_pareto(spark, sf_dir):
    met = rounded(metrics.meeting_targets(predictions(spark, sf_dir), "y", "p", {"sensitivity": 0.5, "specificity": 0.4}, ("split",)))
    return metrics.pareto(met, ("split",), ("sensitivity", "specificity", "ppv", "npv")).select("split", "threshold")


_CUTS = (0.1, 0.25, 0.5, 0.75, 0.9)


@register("net_benefit", f"WITH {PREDICTIONS}, t AS (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75, 0.9]) AS threshold) SELECT threshold, round(count(*) FILTER (p >= threshold AND y = 1) / count(*) - count(*) FILTER (p >= threshold AND y <> 1) / count(*) * (threshold / (1 - threshold)), 6) AS net_benefit FROM predictions, t GROUP BY 1")
def net_benefit(spark, sf_dir):
    return rounded(metrics.net_benefit(predictions(spark, sf_dir), "y", "p", _CUTS))


@register("metric_brier", f"WITH {PREDICTIONS} SELECT split, round(avg((y - p) ** 2), 6) AS brier FROM predictions GROUP BY 1")
def metric_brier(spark, sf_dir):
    return rounded(metrics.brier(predictions(spark, sf_dir), "y", "p", ("split",)))


_BINS = f"WITH {PREDICTIONS}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(y) AS mean_y, avg(p) AS mean_p FROM predictions GROUP BY 1)"


@register("calibration_curve", f"{_BINS} SELECT bin, n, round(mean_y, 6) AS mean_y, round(mean_p, 6) AS mean_p FROM b")
def calibration_curve(spark, sf_dir):
    return rounded(metrics.calibration_bins(predictions(spark, sf_dir), "y", "p"))


@register("calibration_error", f"{_BINS} SELECT round(avg(abs(mean_y - mean_p)), 6) AS mean_calibration_error, round(sum(abs(mean_y - mean_p) * n) / sum(n), 6) AS expected_calibration_error FROM b")
def calibration_error(spark, sf_dir):
    return rounded(metrics.calibration_errors(metrics.calibration_bins(predictions(spark, sf_dir), "y", "p")))


@register(
    "hosmer_lemeshow",
    f"""WITH {PREDICTIONS}, q AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM predictions),
g AS (SELECT len(list_filter(e, lambda x: p > x)) AS g, CAST(sum(y) AS DOUBLE) AS o, sum(p) AS s, count(*) AS n FROM predictions, q GROUP BY 1)
SELECT round(sum((o - s) ** 2 / s + (n - o - (n - s)) ** 2 / (n - s)), 6) AS statistic, 8 AS df FROM g""",
)
def hosmer_lemeshow(spark, sf_dir):
    return rounded(metrics.hosmer_lemeshow(predictions(spark, sf_dir), "y", "p"))


@register("spiegelhalter_z", f"WITH {PREDICTIONS} SELECT split, round(sum(y - p) / sqrt(sum(p * (1 - p))), 6) AS z FROM predictions GROUP BY 1")
def spiegelhalter_z(spark, sf_dir):
    return rounded(metrics.spiegelhalter(predictions(spark, sf_dir), "y", "p", ("split",)))


_PLACE = f"""WITH {PREDICTIONS}, v AS (SELECT a.id, a.y,
  avg(CASE WHEN a.y = 1 THEN (a.p > b.p)::INT + (a.p = b.p)::INT * 0.5::DOUBLE ELSE (b.p > a.p)::INT + (a.p = b.p)::INT * 0.5::DOUBLE END) AS v1,
  avg(CASE WHEN a.y = 1 THEN (a.p2 > b.p2)::INT + (a.p2 = b.p2)::INT * 0.5::DOUBLE ELSE (b.p2 > a.p2)::INT + (a.p2 = b.p2)::INT * 0.5::DOUBLE END) AS v2
  FROM predictions a JOIN predictions b ON a.y <> b.y GROUP BY ALL)"""


def _cov(a: str, b: str) -> str:
    return f"covar_samp({a}, {b}) FILTER (y = 1) / count(*) FILTER (y = 1) + covar_samp({a}, {b}) FILTER (y = 0) / count(*) FILTER (y = 0)"


@register(
    "delong_covariance",
    _PLACE + " " + " UNION ALL ".join(f"SELECT '{na}' AS score_a, '{nb}' AS score_b, round(avg({a}) FILTER (y = 1), 6) AS auc_a, round(avg({b}) FILTER (y = 1), 6) AS auc_b, round({_cov(a, a)}, 8) AS variance_a, round({_cov(b, b)}, 8) AS variance_b, round({_cov(a, b)}, 8) AS covariance FROM v" for a, na, b, nb in (("v1", "p", "v1", "p"), ("v1", "p", "v2", "p2"), ("v2", "p2", "v2", "p2"))),
)
def delong_covariance(spark, sf_dir):
    out = metrics.delong(predictions(spark, sf_dir), "y", ("p", "p2"), "id")
    return out.select("score_a", "score_b", *(F.round(c, 6).alias(c) for c in ("auc_a", "auc_b")), *(F.round(c, 8).alias(c) for c in ("variance_a", "variance_b", "covariance")))


@register("regression_metrics", "SELECT l_suppkey, round(1 - avg((l_quantity - l_extendedprice / 1500) ** 2) / var_pop(l_quantity), 6) AS r2, round(avg(abs(l_quantity - l_extendedprice / 1500)), 6) AS mae, round(avg((l_quantity - l_extendedprice / 1500) ** 2), 6) AS mse, round(sqrt(avg((l_quantity - l_extendedprice / 1500) ** 2)), 6) AS rmse FROM lineitem GROUP BY 1")
def regression_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_extendedprice") / 1500)
    return rounded(metrics.regression(df, "l_quantity", "guess", ("l_suppkey",)))


@register("bootstrap_auc")
def bootstrap_auc(spark, sf_dir):
    return metrics.bootstrap_auc(predictions(spark, sf_dir), "y", "p", "id", rounds=50)


_MS = f"""WITH {SESSIONS}, g AS (SELECT avg(value) AS gm, count(*) AS size, sum(value * value) AS q FROM sessions), r AS (SELECT subject, avg(value) AS m FROM sessions GROUP BY 1), c AS (SELECT session, avg(value) AS m FROM sessions GROUP BY 1),
e AS (SELECT sum((value - r.m - c.m + gm) ** 2) AS se FROM sessions JOIN r USING (subject) JOIN c USING (session), g),
t AS (SELECT (SELECT count(*) FROM r) AS n, (SELECT count(*) FROM c) AS k, (SELECT sum((m - gm) ** 2) FROM r, g) AS sr, (SELECT sum((m - gm) ** 2) FROM c, g) AS sc, se FROM e),
ms AS (SELECT n, k, k * sr / (n - 1) AS ms_rows, n * sc / (k - 1) AS ms_columns, se / ((n - 1) * (k - 1)) AS ms_error FROM t)"""


@register("two_way_mean_squares", f"{_MS} SELECT n, k, round(ms_rows / 1e6::DOUBLE, 4) AS ms_rows, round(ms_columns / 1e6::DOUBLE, 4) AS ms_columns, round(ms_error / 1e6::DOUBLE, 4) AS ms_error FROM ms")
def two_way_mean_squares(spark, sf_dir):
    ms = reliability.mean_squares(sessions(spark, sf_dir), "subject", "session", "value")
    return ms.select("n", "k", *(F.round(F.col(c) / 1e6, 4).alias(c) for c in ("ms_rows", "ms_columns", "ms_error")))


@register(
    "icc_all_types",
    f"""{_MS}, w AS (SELECT *, (ms_columns * (k - 1) + ms_error * (n - 1) * (k - 1)) / (n * (k - 1)) AS mw FROM ms)
SELECT n, k, round((ms_rows - mw) / (ms_rows + (k - 1) * mw), 6) AS icc1, round((ms_rows - ms_error) / (ms_rows + (k - 1) * ms_error + k / n * (ms_columns - ms_error)), 6) AS icc2, round((ms_rows - ms_error) / (ms_rows + (k - 1) * ms_error), 6) AS icc3,
  round((ms_rows - mw) / ms_rows, 6) AS icc1k, round((ms_rows - ms_error) / (ms_rows + (ms_columns - ms_error) / n), 6) AS icc2k, round((ms_rows - ms_error) / ms_rows, 6) AS icc3k,
  round(greatest(0.0, least(1.0, (ms_rows - ms_error) / (ms_rows + (k - 1) * ms_error + k / n * (ms_columns / n - ms_error)))), 6) AS icc3a FROM w""",
)
def icc_all_types(spark, sf_dir):
    return rounded(reliability.icc(sessions(spark, sf_dir), "subject", "session", "value"))


@register("kappa_cohen", "WITH c AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT avg((a = b)::INT) AS po, avg((a = 1)::INT) * avg((b = 1)::INT) + avg((a = 0)::INT) * avg((b = 0)::INT) AS pe FROM c) SELECT round((po - pe) / (1 - pe), 6) AS kappa FROM t")
def kappa_cohen(spark, sf_dir):
    return rounded(reliability.cohen_kappa(table(spark, sf_dir, "labels"), "quality", "toxic"))


_RATED = "r AS (SELECT l_orderkey AS item, l_returnflag AS category FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4))"


@register("kappa_fleiss", f"WITH {_RATED}, c AS (SELECT item, category, count(*) AS n FROM r GROUP BY ALL), i AS (SELECT item, sum(n) AS m, sum(n * n) AS s FROM c GROUP BY 1), s AS (SELECT sum((t / a) ** 2) AS pe FROM (SELECT category, sum(n) AS t, sum(sum(n)) OVER () AS a FROM c GROUP BY 1)) SELECT count(*) AS items, round((avg((s - m) / (m * (m - 1))) - any_value(pe)) / (1 - any_value(pe)), 6) AS kappa FROM i, s")
def kappa_fleiss(spark, sf_dir):
    """Orders with four lines are items with four ratings: the operator wants equal numbers."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_returnflag").alias("category"))
    full = i.groupBy("item").count().where("count = 4").select("item")
    return rounded(reliability.fleiss_kappa(i.join(full, "item", "left_semi"), "item", "category"))


@register("krippendorff_alpha", f"WITH {SESSIONS}, d AS (SELECT a.subject, sum((a.value - b.value) ** 2) / 2.0 AS s FROM sessions a JOIN sessions b USING (subject) GROUP BY 1), g AS (SELECT count(*) AS n, 2 * (count(*) * sum(value * value) - sum(value) ** 2) / (count(*) * (count(*) - 1.0)) AS de FROM sessions) SELECT round(1 - (SELECT sum(s) FROM d) / n / de, 6) AS alpha FROM g")
def krippendorff_alpha(spark, sf_dir):
    return rounded(reliability.krippendorff_interval(sessions(spark, sf_dir), "subject", "value"))


@register("effect_sizes_paired", f"WITH {SESSIONS}, p AS (SELECT a.value AS a, b.value AS b FROM sessions a JOIN sessions b USING (subject) WHERE a.session = 1 AND b.session = 2) SELECT round(avg(sign(a - b)), 6) AS cliffs_delta, round(avg(a - b) / stddev_samp(a - b), 6) AS cohens_d FROM p")
def effect_sizes_paired(spark, sf_dir):
    wide = sessions(spark, sf_dir).where("session <= 2").groupBy("subject").pivot("session", [1, 2]).agg(F.first("value"))
    a, b = F.col("1"), F.col("2")
    return rounded(wide.agg(reliability.cliffs_delta_paired(a, b).alias("cliffs_delta"), reliability.cohens_d_paired(a, b).alias("cohens_d")))


@register(
    "benjamini_hochberg",
    "WITH t AS (SELECT p_partkey, round(p_retailprice * 7 % 997 / 1000, 6) AS pv FROM part), r AS (SELECT *, row_number() OVER (ORDER BY pv) AS k, count(*) OVER () AS n FROM t) SELECT p_partkey, round(least(1.0, min(pv * n / k) OVER (ORDER BY k DESC)), 6) AS q FROM r",
)
def benjamini_hochberg(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") * 7 % 997 / 1000, 6).alias("pv"))
    return rounded(reliability.benjamini_hochberg(p, "pv").select("p_partkey", "q"))


@register("precision_panel", "WITH s AS (SELECT o_custkey AS subject, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n, o_totalprice AS v, o_custkey % 5 AS grp FROM orders), t AS (SELECT subject, k, v, grp FROM s WHERE n >= 2 AND k <= 2), g AS (SELECT grp, avg(v) AS gm FROM t GROUP BY 1), r AS (SELECT grp, subject, avg(v) AS m FROM t GROUP BY ALL), c AS (SELECT grp, k, avg(v) AS m FROM t GROUP BY ALL), e AS (SELECT grp, sum((v - r.m - c.m + gm) ** 2) AS se, count(DISTINCT subject) AS n FROM t JOIN r USING (grp, subject) JOIN c USING (grp, k) JOIN g USING (grp) GROUP BY 1), a AS (SELECT grp, 2 * sum((m - gm) ** 2) / (count(*) - 1) AS mr FROM r JOIN g USING (grp) GROUP BY 1) SELECT grp, n, round((mr - se / (n - 1)) / (mr + se / (n - 1)), 6) AS icc3 FROM e JOIN a USING (grp)")
def precision_panel(spark, sf_dir):
    """The fixed-rater coefficient by group, from one plan over all groups."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey")
    t = o.withColumn("k", F.row_number().over(w.orderBy("o_orderkey"))).withColumn("n", F.count("*").over(w)).where("n >= 2 and k <= 2").withColumn("grp", F.col("o_custkey") % 5)
    return rounded(reliability.icc(t, "o_custkey", "k", "o_totalprice", ("grp",)).select("grp", "n", "icc3"))
