"""Feature preprocessing, unit statistics, combiners and voxel features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..functions.expr import compile_expression
from ..operators import prep, units
from .inputs import CELLS, FEATURES, HOLED, cells, holed, rounded, table
from .inputs import units as unit_rows

KEYS = ("l_suppkey", "l_orderkey", "l_linenumber")
_KEYS = ", ".join(KEYS)
_ONE = ("l_extendedprice",)
_FIN = "l_extendedprice"


def _scaled(name: str, method: prep.Method, by: tuple[str, ...], sql: str, digits: int = 6) -> None:
    """Register a method over the holed price, learned by group or over the cohort."""

    def query(spark, sf_dir):
        df = holed(spark, sf_dir)
        state = prep.fit(df, _ONE, method, by)
        return rounded(prep.apply(df, state, _ONE, method, by).select(*KEYS, *_ONE), digits)

    over = "OVER (PARTITION BY l_suppkey)" if by else "OVER ()"
    register(name, f"SELECT {_KEYS}, round({sql.format(x=_FIN, over=over)}, {digits}) AS l_extendedprice FROM {HOLED} t")(query)


def _span(width: str) -> str:
    return f"(CASE WHEN {width} IS NULL OR {width} = 0 THEN 1.0 ELSE {width} END)"


for _by, _tag in (((), "cohort"), (("l_suppkey",), "subject")):
    _scaled(f"prep_impute_mean_{_tag}", prep.impute("mean"), _by, "coalesce({x}, avg({x}) {over}, 0)", 4)
    _scaled(f"prep_minmax_{_tag}", prep.minmax(), _by, "({x} - min({x}) {over}) / " + _span("(max({x}) {over} - min({x}) {over})"))
    _scaled(f"prep_zscore_{_tag}", prep.zscore(), _by, "({x} - avg({x}) {over}) / " + _span("(stddev_samp({x}) {over})"))
    _scaled(f"prep_robust_{_tag}", prep.robust(), _by, "({x} - quantile_cont({x}, 0.5) {over}) / " + _span("(quantile_cont({x}, 0.75) {over} - quantile_cont({x}, 0.25) {over})"))
    _scaled(f"prep_winsorize_{_tag}", prep.winsorize(), _by, "CASE WHEN {x} IS NULL THEN NULL ELSE least(greatest({x}, quantile_cont({x}, 0.05) {over}), quantile_cont({x}, 0.95) {over}) END", 4)
    _scaled(f"prep_log_{_tag}", prep.log_shift(), _by, "ln({x} - min({x}) {over} + 1)")
    _scaled(f"prep_binning_uniform_{_tag}", prep.binning(10, "uniform"), _by, "CASE WHEN {x} IS NULL THEN NULL WHEN max({x}) {over} > min({x}) {over} THEN greatest(0.0, least(floor(({x} - min({x}) {over}) / (max({x}) {over} - min({x}) {over}) * 10), 9.0)) ELSE 0.0 END")
    _scaled(f"prep_binning_quantile_{_tag}", prep.binning(4, "quantile"), _by, "CAST(CASE WHEN {x} IS NULL THEN NULL ELSE ({x} >= quantile_cont({x}, 0.25) {over})::INT + ({x} >= quantile_cont({x}, 0.5) {over})::INT + ({x} >= quantile_cont({x}, 0.75) {over})::INT END AS DOUBLE)")
_scaled("prep_impute_median_cohort", prep.impute("median"), (), "coalesce({x}, quantile_cont({x}, 0.5) {over}, 0)", 4)
_scaled("prep_impute_zero_cohort", prep.impute("zero"), (), "coalesce({x}, 0)", 4)


@register(
    "prep_zscore_pooled",
    f"""WITH u AS (SELECT unnest([l_quantity, l_discount, l_tax]) AS v FROM lineitem), s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM u)
SELECT {_KEYS}, round((l_quantity - m) / d, 6) AS l_quantity, round((l_discount - m) / d, 6) AS l_discount, round((l_tax - m) / d, 6) AS l_tax FROM lineitem, s""",
)
def prep_zscore_pooled(spark, sf_dir):
    names = ("l_quantity", "l_discount", "l_tax")
    return rounded(prep.zscore_pooled(unit_rows(spark, sf_dir).select(*KEYS, *names), names))


@register(
    "prep_chain_cohort",
    f"""WITH a AS (SELECT {_KEYS}, coalesce({_FIN}, avg({_FIN}) OVER ()) AS x FROM {HOLED} t),
b AS (SELECT {_KEYS}, least(greatest(x, quantile_cont(x, 0.05) OVER ()), quantile_cont(x, 0.95) OVER ()) AS x FROM a)
SELECT {_KEYS}, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS l_extendedprice FROM b""",
)
def prep_chain_cohort(spark, sf_dir):
    df = holed(spark, sf_dir)
    chain = prep.Chain([("winsorize", {}), ("minmax", {})], _ONE).fit(df)
    return rounded(chain.transform(df).select(*KEYS, *_ONE))


@register(
    "prep_train_fitted_table",
    f"""WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d FROM lineitem WHERE l_returnflag <> 'R')
SELECT {_KEYS}, round((l_extendedprice - m) / d, 6) AS l_extendedprice FROM lineitem, s WHERE l_returnflag = 'R'""",
)
def prep_train_fitted_table(spark, sf_dir):
    """A table step learned on training rows and replayed on the others."""
    df = table(spark, sf_dir, "lineitem").select(*KEYS, "l_returnflag", *_ONE)
    chain = prep.Chain([("zscore", {})], _ONE).fit(df.where("l_returnflag <> 'R'"))
    return rounded(chain.transform(df.where("l_returnflag = 'R'")).select(*KEYS, *_ONE))


@register("prep_variance_filter", "SELECT round(var_samp(l_extendedprice), 2) AS variance, 'l_extendedprice' AS feature FROM lineitem UNION ALL SELECT round(var_samp(l_quantity), 2), 'l_quantity' FROM lineitem")
def prep_variance_filter(spark, sf_dir):
    df = unit_rows(spark, sf_dir)
    kept = prep.keep_by_variance(df, FEATURES, threshold=1.0)
    var = prep.variances(df, FEATURES)
    return spark.createDataFrame([(f, var[f]) for f in kept], "feature string, variance double").withColumn("variance", F.round("variance", 2))


@register("prep_correlation_filter_pearson", "SELECT unnest(CASE WHEN abs(corr(l_quantity, l_extendedprice)) > 0.5 THEN ['l_quantity', 'l_discount', 'l_tax'] ELSE ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax'] END) AS feature FROM lineitem")
def prep_correlation_filter_pearson(spark, sf_dir):
    kept = prep.keep_by_correlation(unit_rows(spark, sf_dir), FEATURES, 0.5, "pearson")
    return spark.createDataFrame([(f,) for f in kept], "feature string")


@register(
    "prep_spearman",
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho FROM r""",
)
def prep_spearman(spark, sf_dir):
    rho = prep.correlations(unit_rows(spark, sf_dir), ("l_quantity", "l_extendedprice"), "spearman")
    return rounded(spark.createDataFrame([(v,) for v in rho.values()], "rho double"))


@register("rank_midrank", "SELECT l_orderkey, l_linenumber, CAST(rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS DOUBLE) AS rank_l_quantity FROM lineitem")
def rank_midrank(spark, sf_dir):
    return prep.midranks(unit_rows(spark, sf_dir), ("l_quantity",)).select("l_orderkey", "l_linenumber", F.col("rank_l_quantity").cast("double"))


def _statistic(name: str, kind: str, sql: str) -> None:
    cols = ", ".join(f"round({sql.format(x=f)}, 6) AS {f}" for f in FEATURES)
    register(name, f"SELECT l_suppkey, l_linenumber, {cols} FROM lineitem GROUP BY ALL")(lambda spark, sf_dir: rounded(units.statistic(unit_rows(spark, sf_dir), ("l_suppkey", "l_linenumber"), FEATURES, kind)))


_statistic("unit_mean", "mean", "avg({x})")
_statistic("unit_std", "std", "stddev_samp({x})")
_statistic("unit_percentile", "percentile", "quantile_cont({x}, 0.9)")


@register("unit_table_habitat", "SELECT l_suppkey AS subject, CAST(1 + CAST(floor(l_quantity) AS INTEGER) % 3 AS INTEGER) AS habitats, count(*) AS count, round(avg(l_extendedprice), 6) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY ALL")
def unit_table_habitat(spark, sf_dir):
    df = unit_rows(spark, sf_dir).withColumn("habitats", (1 + F.col("l_quantity").cast("int") % 3).cast("int")).withColumnRenamed("l_suppkey", "subject")
    out = units.units_frame(df, ("subject", "habitats"), ("l_extendedprice", "l_discount"))
    return out.withColumn("l_extendedprice", F.round("l_extendedprice", 6)).withColumn("l_discount", F.round("l_discount", 6))


def _combined(name: str, column, sql: str) -> None:
    register(name, f"SELECT {_KEYS}, round({sql}, 6) AS v FROM lineitem")(lambda spark, sf_dir: rounded(unit_rows(spark, sf_dir).select(*KEYS, column().alias("v"))))


_combined("combine_ratio", lambda: units.ratio("l_quantity", "l_tax"), "l_quantity / (l_tax + 1e-8::DOUBLE)")
_combined("combine_difference", lambda: units.difference("l_quantity", "l_discount"), "l_quantity - l_discount")
_combined("combine_average", lambda: units.average({"l_quantity": 1.0, "l_discount": 3.0}), "0.25::DOUBLE * l_quantity + 0.75::DOUBLE * l_discount")
_combined("combine_weighted_concat", lambda: units.weighted({"l_tax": 2.5})[0], "l_tax * 2.5::DOUBLE")
_combined("expression_arithmetic", lambda: compile_expression("clip(sqrt(abs(l_quantity - 20)) + l_tax ** 2, 0.5, 4) / maximum(l_discount, 0.01)", FEATURES), "least(greatest(sqrt(abs(l_quantity - 20)) + pow(l_tax, 2), 0.5::DOUBLE), 4.0::DOUBLE) / greatest(l_discount, 0.01::DOUBLE)")
_combined("expression_modulo", lambda: compile_expression("(0 - l_quantity) % 7 + l_quantity // 4", FEATURES), "((0 - l_quantity) - floor((0 - l_quantity) / 7) * 7) + floor(l_quantity / 4)")
_combined("expression_logs", lambda: compile_expression("log10(l_extendedprice) * exp(-l_tax) + log(minimum(l_quantity, 30)) + square(l_discount)", FEATURES), "log10(l_extendedprice) * exp(-l_tax) + ln(least(l_quantity, 30.0::DOUBLE)) + l_discount * l_discount")

_PHASES = ("view", "click", "signup", "purchase")


@register(
    "kinetic_slopes",
    """WITH p AS (SELECT user_id, avg(CASE WHEN event_type = 'view' THEN value END) AS a, avg(CASE WHEN event_type = 'click' THEN value END) AS b, avg(CASE WHEN event_type = 'signup' THEN value END) AS c, avg(CASE WHEN event_type = 'purchase' THEN value END) AS d,
  epoch_us(min(CASE WHEN event_type = 'click' THEN ts END)) / 1e6 AS tb, epoch_us(min(CASE WHEN event_type = 'signup' THEN ts END)) / 1e6 AS tc, epoch_us(min(CASE WHEN event_type = 'purchase' THEN ts END)) / 1e6 AS td FROM events GROUP BY 1)
SELECT user_id, round(greatest(b - a, 0.0) / (25.0::DOUBLE + 1e-6::DOUBLE), 6) AS wash_in_slope, round((c - b) / (tc - tb + 1e-6::DOUBLE), 6) AS wash_out_slope_early, round((d - c) / (td - tc + 1e-6::DOUBLE), 6) AS wash_out_slope_late FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""",
)
def kinetic_slopes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cols = [F.avg(F.when(F.col("event_type") == p, F.col("value"))).alias(p) for p in _PHASES] + [F.min(F.when(F.col("event_type") == p, F.col("ts"))).alias(f"t_{p}") for p in _PHASES]
    wide = e.groupBy("user_id").agg(*cols).dropna(subset=list(_PHASES))
    slopes = units.kinetic(_PHASES, [F.col(f"t_{p}") for p in _PHASES])
    return rounded(wide.select("user_id", *(c.alias(k) for k, c in slopes.items())))


@register(
    "voxel_local_entropy",
    f"""WITH {CELLS}, l AS (SELECT subject, z, y, x, CAST(CASE WHEN max(tax) OVER w > min(tax) OVER w THEN round_even((tax - min(tax) OVER w) / (max(tax) OVER w - min(tax) OVER w) * 31, 0) ELSE 0 END AS INTEGER) AS level FROM cells WINDOW w AS (PARTITION BY subject)),
o AS (SELECT unnest([-1, 0, 1]) AS d),
c AS (SELECT subject, z + a.d AS z, y + b.d AS y, x + c.d AS x, level, count(*) AS n FROM l, o a, o b, o c GROUP BY ALL),
e AS (SELECT subject, z, y, x, sum(-(n / 27.0::DOUBLE) * log2(n / 27.0::DOUBLE)) AS entropy FROM c GROUP BY ALL)
SELECT subject, z, y, x, round(entropy, 6) AS entropy FROM l JOIN e USING (subject, z, y, x)""",
)
def voxel_local_entropy(spark, sf_dir):
    return rounded(units.local_entropy(cells(spark, sf_dir), "subject", "tax"))


@register(
    "texture_first_order",
    f"""WITH {CELLS.replace("cells AS", "whole AS")}, cells AS (SELECT * REPLACE (round(tax * 100) AS tax) FROM whole), b AS (SELECT subject, label, count(*) AS n, sum(tax * tax) AS energy, min(tax) AS minimum, max(tax) AS maximum, avg(tax) AS mean, quantile_cont(tax, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM cells GROUP BY ALL),
m AS (SELECT subject, label, avg(abs(tax - mean)) AS mad, avg((tax - mean) ** 2) AS m2, avg((tax - mean) ** 3) AS m3, avg((tax - mean) ** 4) AS m4, avg(CASE WHEN tax >= q[1] AND tax <= q[5] THEN tax END) AS nm FROM cells JOIN b USING (subject, label) GROUP BY ALL),
r AS (SELECT subject, label, avg(CASE WHEN tax >= q[1] AND tax <= q[5] THEN abs(tax - nm) END) AS rmad FROM cells JOIN b USING (subject, label) JOIN m USING (subject, label) GROUP BY ALL),
h AS (SELECT subject, label, floor(tax / 2.0::DOUBLE) AS v, count(*) AS c FROM cells GROUP BY ALL),
s AS (SELECT subject, label, sum(-p * log2(p + 2.2e-16::DOUBLE)) AS entropy, sum(p * p) AS uniformity FROM (SELECT subject, label, c / sum(c) OVER (PARTITION BY subject, label) AS p FROM h) GROUP BY ALL)
SELECT subject, label, round(energy, 6) AS energy, round(energy, 6) AS total_energy, round(entropy, 6) AS entropy, round(minimum, 6) AS minimum, round(q[1], 6) AS percentile_10, round(q[5], 6) AS percentile_90, round(maximum, 6) AS maximum, mean, round(q[3], 6) AS median,
  round(q[4] - q[2], 6) AS interquartile_range, round(maximum - minimum, 6) AS range, round(mad, 6) AS mean_absolute_deviation, round(rmad, 6) AS robust_mean_absolute_deviation, round(sqrt(energy / n), 6) AS root_mean_squared, round(sqrt(m2), 6) AS standard_deviation,
  round(CASE WHEN m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0.0 END, 6) AS skewness, round(CASE WHEN m2 > 0 THEN m4 / (m2 * m2) ELSE 0.0 END, 6) AS kurtosis, round(m2, 6) AS variance, round(uniformity, 6) AS uniformity
FROM b JOIN m USING (subject, label) JOIN r USING (subject, label) JOIN s USING (subject, label)""",
)
def texture_first_order(spark, sf_dir):
    """Taxes in whole hundredths: their sums are exact, so no mean depends on the order of summation, and it isn't rounded."""
    found = units.first_order(cells(spark, sf_dir).withColumn("tax", F.round(F.col("tax") * 100)), ("subject", "label"), "tax", bin_width=2.0)
    exact = found.select("subject", "label", "mean")
    return rounded(found.drop("mean")).join(exact, ["subject", "label"])
