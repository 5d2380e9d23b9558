"""Agreement between repeated measurements and raters, effect sizes, q-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import f_ppf
from .running import running


def mean_squares(df: DataFrame, target: str, rater: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, n, k, ms_rows, ms_columns, ms_error) of complete two-way tables in long form.

    Targets without a value of every rater must be gone already.
    """
    rows = df.groupBy(*by, target).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.count("*").alias("n"), F.var_samp("m").alias("v_rows"))
    cols = df.groupBy(*by, rater).agg(F.avg(value).alias("m")).groupBy(*by).agg(F.count("*").alias("k"), F.var_samp("m").alias("v_cols"))
    every = df.groupBy(*by).agg(F.var_pop(value).alias("v"), F.count("*").alias("size"))
    joined = rows.join(cols, list(by)).join(every, list(by)) if by else _beside(rows, cols, every)
    n, k = F.col("n"), F.col("k")
    ss_rows, ss_cols = F.col("v_rows") * (n - 1) * k, F.col("v_cols") * (k - 1) * n
    ss_error = F.greatest(F.col("v") * F.col("size") - ss_rows - ss_cols, F.lit(0.0))
    return joined.select(*by, "n", "k", (F.col("v_rows") * k).alias("ms_rows"), (F.col("v_cols") * n).alias("ms_columns"), (ss_error / ((n - 1) * (k - 1))).alias("ms_error"))


def _beside(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    out = frames[0].withColumn("__one", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def icc_columns() -> dict[str, Column]:
    """The coefficients as expressions over :func:`mean_squares`; the plain forms are not clipped, the voxel form is."""
    n, k, r, c, e = map(F.col, ("n", "k", "ms_rows", "ms_columns", "ms_error"))
    within = (c * (k - 1) + e * (n - 1) * (k - 1)) / (n * (k - 1))
    icc3a = F.try_divide(r - e, r + (k - 1) * e + (k / n) * (c / n - e))
    return {
        "icc1": F.try_divide(r - within, r + (k - 1) * within),
        "icc2": F.try_divide(r - e, r + (k - 1) * e + (k / n) * (c - e)),
        "icc3": F.try_divide(r - e, r + (k - 1) * e),
        "icc1k": F.try_divide(r - within, r),
        "icc2k": F.try_divide(r - e, r + (c - e) / n),
        "icc3k": F.try_divide(r - e, r),
        "icc3a": F.when(e == 0, F.when(r > 0, 1.0).otherwise(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), icc3a))),
    }


def icc(df: DataFrame, target: str, rater: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    ms = mean_squares(df, target, rater, value, by)
    return ms.select(*by, "n", "k", *(c.alias(name) for name, c in icc_columns().items()))


def icc3_limits(ms: dict, alpha: float = 0.05) -> tuple[float, float]:
    """Confidence limits of the fixed-rater coefficient from one row of mean squares, clipped to 0 and 1."""
    n, k = ms["n"], ms["k"]
    if ms["ms_error"] == 0:
        return (1.0, 1.0) if ms["ms_rows"] > 0 else (0.0, 0.0)
    f = ms["ms_rows"] / ms["ms_error"]
    q = f_ppf(1 - alpha / 2, n - 1, (n - 1) * (k - 1))
    low, high = ((x - 1) / (x + k - 1) for x in (f / q, f * q))
    return min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)


def icc2_limits(ms: dict, alpha: float = 0.05) -> tuple[float, float]:
    """Satterthwaite limits of the random-rater coefficient, clipped to 0 and 1."""
    n, k, r, c, e = (ms[x] for x in ("n", "k", "ms_rows", "ms_columns", "ms_error"))
    if e == 0:
        return (1.0, 1.0) if r > 0 else (0.0, 0.0)
    rho = min(max((r - e) / (r + (k - 1) * e + k / n * (c - e)), 0.0), 1.0)
    fj = c / e
    a = k * rho * fj
    b = n * (1 + (k - 1) * rho) - k * rho
    v = (n - 1) * (k - 1) * (a + b) ** 2 / ((n - 1) * a**2 + b**2)
    up, down = f_ppf(1 - alpha / 2, n - 1, v), f_ppf(1 - alpha / 2, v, n - 1)
    mixed = k * c + (k * n - k - n) * e
    low, high = n * (r - up * e) / (up * mixed + n * r), n * (down * r - e) / (mixed + n * down * r)
    return min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)


def cohen_kappa(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, kappa) of two raters, from the contingency counts."""
    cell = df.groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = cell.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ra, rb = (cell.groupBy(*by, F.col(c).alias("v")).agg(F.sum("n").alias(f"n{c}")) for c in "ab")
    chance = ra.join(rb, [*by, "v"]).withColumn("__one", F.lit(1)).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("c"))
    joined = total.join(chance, list(by), "left") if by else _beside(total, chance)
    t = F.col("t")
    po, pe = F.col("same") / t, F.coalesce("c", F.lit(0)) / (t * t)
    return joined.select(*by, F.try_divide(po - pe, 1 - pe).alias("kappa"))


def fleiss_kappa(df: DataFrame, item: str, category: str) -> DataFrame:
    """(items, kappa) of ratings in long form; items with other than the usual number of ratings must be gone."""
    cell = df.groupBy(item, F.col(category).alias("c")).agg(F.count("*").alias("n"))
    each = cell.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("s2"))
    m = F.col("m")
    agreement = each.agg(F.count("*").alias("items"), F.avg((F.col("s2") - m) / (m * (m - 1))).alias("po"))
    shares = cell.groupBy("c").agg(F.sum("n").alias("n"))
    chance = shares.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe"))
    return _beside(agreement, chance).select("items", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")).alias("kappa"))


def krippendorff_interval(df: DataFrame, item: str, value: str) -> DataFrame:
    """(alpha) at the interval level from sums: squared differences within items against those over all values.

    Sums of squares stand in for pairs, so nothing is joined with itself.
    """
    x = F.col(value).cast("double")
    each = df.where(F.col(value).isNotNull()).groupBy(item).agg(F.count("*").alias("m"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).where("m > 1")
    m, s, q = F.col("m"), F.col("s"), F.col("q")
    n = F.sum(m)
    within = F.sum(2 * (m * q - s * s) / (m - 1)) / n
    overall = 2 * (n * F.sum(q) - F.sum(s) * F.sum(s)) / (n * (n - 1))
    return each.agg(F.try_divide(overall - within, overall).alias("alpha"))


def cliffs_delta_paired(a: Column, b: Column) -> Column:
    return F.avg(F.signum(a - b))


def cohens_d_paired(a: Column, b: Column) -> Column:
    return F.try_divide(F.avg(a - b), F.stddev_samp(a - b))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str] = ()) -> DataFrame:
    """The rows with ``q``: the smallest p n / rank from here upwards, at most 1."""
    whole = Window.partitionBy(*by)
    up = whole.orderBy(p)
    ranked = df.withColumn("__r", F.row_number().over(up)).withColumn("__n", F.count("*").over(whole))
    raw = ranked.withColumn("__raw", F.col(p) * F.col("__n") / F.col("__r"))
    down = whole.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn("q", F.least(F.lit(1.0), F.min("__raw").over(down))).drop("__r", "__n", "__raw")


def cliffs_delta(df: DataFrame, value: str, group: str) -> DataFrame:
    """(delta) of group 1 over group 0, from counts by distinct value: pairs are never formed."""
    n = df.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(group) == 1).alias("a"), F.count_if(F.col(group) == 0).alias("b")).where("v is not null")
    won = running(n, (), "v", {"upto": "b"}).select("a", "b", (F.col("a") * (F.col("upto") - F.col("b"))).alias("less"), (F.col("a") * F.col("upto")).alias("most"))
    total = won.agg(F.sum("less").alias("less"), F.sum("most").alias("most"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    pairs = F.col("na").cast("double") * F.col("nb")
    return total.select(F.try_divide(F.col("less") - (pairs - F.col("most")), pairs).alias("delta"))


def cohens_d(df: DataFrame, value: str, group: str) -> DataFrame:
    """(d) of group 1 over group 0 with the pooled deviation."""
    one, two = (F.when(F.col(group) == g, F.col(value)) for g in (1, 0))
    pooled = ((F.count(one) - 1) * F.var_samp(one) + (F.count(two) - 1) * F.var_samp(two)) / (F.count(one) + F.count(two) - 2)
    return df.agg(F.try_divide(F.avg(one) - F.avg(two), F.sqrt(pooled)).alias("d"))


def wilcoxon(df: DataFrame, a: str, b: str) -> dict[str, float]:
    """Signed-rank statistic of paired columns and its two-sided p by the normal limit with tie correction; zero differences go."""
    import math

    from ..functions.dist import normal_sf

    d = F.col(a) - F.col(b)
    n = df.select(d.alias("d")).where("d is not null and d <> 0").groupBy(F.abs("d").alias("v")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count("*").alias("n"))
    r = running(n, (), "v", {"upto": "n"}).withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2).agg(F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("t")).first()
    if not r["n"]:
        return {"w": 0.0, "p": 1.0}
    m = r["n"]
    sd = math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - r["t"] / 48)
    return {"w": r["w"], "p": min(1.0, 2 * normal_sf(abs(r["w"] - m * (m + 1) / 4) / sd)) if sd else 1.0}


def retest_mapping(test: DataFrame, retest: DataFrame, habitat: str, features: Sequence[str]) -> DataFrame:
    """(test, retest, similarity): for each region of the first table the one of the second whose median profile correlates most, ties to the smaller.

    Medians are one row a region, so the comparison is among a few rows.
    """
    profile = lambda df, name: df.groupBy(F.col(habitat).alias(name)).agg(F.array(*(F.median(f) for f in features)).alias(f"m_{name}"))
    pairs = profile(test, "test").withColumn("__one", F.lit(1)).join(profile(retest, "retest").withColumn("__one", F.lit(1)), "__one")
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v) / F.size(c)
    a, b = F.col("m_test"), F.col("m_retest")
    cov = lambda x, y: mean(F.zip_with(x, y, lambda u, v: u * v)) - mean(x) * mean(y)
    r = F.try_divide(cov(a, b), F.sqrt(cov(a, a) * cov(b, b)))
    scored = pairs.select("test", "retest", F.coalesce(r, F.lit(-1.0)).alias("similarity"))
    best = F.row_number().over(Window.partitionBy("test").orderBy(F.desc("similarity"), "retest"))
    return scored.withColumn("__k", best).where("__k = 1").drop("__k")


def precise_features(panels: DataFrame, threshold: float = 0.5, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """(feature) whose lower limit reaches the threshold in every experiment of rows (experiment, feature, lcl), plus and minus given names."""
    kept = panels.groupBy("feature").agg(F.bool_and(F.coalesce(F.col("lcl") >= threshold, F.lit(False))).alias("ok")).where("ok").select("feature")
    if include:
        kept = kept.union(panels.sparkSession.createDataFrame([(f,) for f in include], "feature string")).distinct()
    return kept.where(~F.col("feature").isin(list(exclude))) if exclude else kept
