"""Evaluation of predictions: panels, thresholds, calibration, AUC comparison, regression.

Rows are (y 0 or 1, p) with optional group columns.  Ranks and curves are built on
distinct scores (counted first, combined before the shuffle), so ties cost nothing
and the ordered step sees one row per distinct score of a group.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, normal_ppf, normal_sf
from .prep import finite
from .running import running


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def clean(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Rows with a known outcome and a finite score, and the hard label at the threshold."""
    kept = df.withColumn(p, finite(F.col(p))).where(F.col(p).isNotNull() & F.col(y).isNotNull())
    return kept.withColumn("y_hat", (F.col(p) >= threshold).cast("int"))


def confusion(df: DataFrame, y: str, y_hat: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, y, y_hat, n) over the observed cells."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg(F.count("*").alias("n"))


def panel_columns(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    sensitivity, ppv = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "sensitivity": sensitivity,
        "specificity": ratio(tn, tn + fp),
        "ppv": ppv,
        "npv": ratio(tn, tn + fn),
        "f1_score": ratio(2 * ppv * sensitivity, ppv + sensitivity),
    }


def panel(df: DataFrame, y: str, y_hat: Column, by: Sequence[str] = ()) -> DataFrame:
    """The six basic metrics from one pass over the rows."""
    one, hit = F.col(y) == 1, y_hat.cast("int") == 1
    n = df.groupBy(*by).agg(*(F.count_if(c).cast("double").alias(k) for k, c in {"tp": one & hit, "fp": ~one & hit, "tn": ~one & ~hit, "fn": one & ~hit}.items()))
    return n.select(*by, *(c.alias(k) for k, c in panel_columns(*map(F.col, ("tp", "fp", "tn", "fn"))).items()))


def at_threshold(df: DataFrame, y: str, p: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return panel(df, y, F.col(p) >= threshold, by)


def curve(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, threshold, tp, fp, tn, fn) at every distinct score, calling scores at or above it positive."""
    n = df.groupBy(*by, F.col(p).alias("threshold")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    out = running(n, by, "threshold", {"tp": "pos", "fp": "neg"}, descending=True)
    if by:
        whole = out.groupBy(*(F.col(k).alias(f"__{k}") for k in by)).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
        out = out.join(whole, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
    else:
        pos, neg = out.agg(F.sum("pos"), F.sum("neg")).first()
        out = out.withColumns({"__p": F.lit(pos or 0), "__n": F.lit(neg or 0)})
    return out.select(*by, "threshold", "tp", "fp", (F.col("__n") - F.col("fp")).alias("tn"), (F.col("__p") - F.col("tp")).alias("fn"))


def _curve_panel(df: DataFrame, y: str, p: str, by: Sequence[str]) -> DataFrame:
    c = curve(df, y, p, by)
    return c.select(*by, "threshold", *(m.alias(k) for k, m in panel_columns(*(F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn"))).items()))


def auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, auc): the midrank statistic, 0.5 of each tie; null with one class only."""
    n = df.groupBy(*by, F.col(p).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    n = running(n, by, "s", {"upto": "neg"})
    wins = n.withColumn("w", F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return wins.groupBy(*by).agg(F.try_divide(F.sum("w"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def youden(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, threshold, youden): the score with the largest sensitivity + specificity - 1, of equal ones the highest."""
    m = _curve_panel(df, y, p, by).withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1)
    best = F.max_by(F.struct("threshold", "youden"), F.struct("youden", "threshold"))
    return m.groupBy(*by).agg(best.alias("b")).select(*by, "b.threshold", "b.youden")


def meeting_targets(df: DataFrame, y: str, p: str, targets: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(group, threshold and the panel) of the scores at which every target is met."""
    m = _curve_panel(df, y, p, by)
    for name, least in targets.items():
        m = m.where(F.col(name) >= least)
    return m


def pareto(points: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Points that no other point of the group equals or beats in every measure and beats in one.

    Equal points are first made one; dominance is then an anti join within the group.
    """
    distinct = points.select(*by, *names).distinct()
    a, b = distinct.alias("a"), distinct.alias("b")
    same = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in by]
    no_worse = [F.col(f"b.{n}") >= F.col(f"a.{n}") for n in names]
    better = [F.col(f"b.{n}") > F.col(f"a.{n}") for n in names]
    beaten = no_worse[0]
    for c in (*same, *no_worse[1:]):
        beaten &= c
    some = better[0]
    for c in better[1:]:
        some |= c
    return points.join(a.join(b, beaten & some, "left_anti"), [*by, *names], "left_semi")


def net_benefit(df: DataFrame, y: str, p: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, net_benefit) of treating at or above each threshold, in one pass."""
    hits = [F.count_if((F.col(p) >= t) & (F.col(y) == 1)) / F.count("*") - F.count_if((F.col(p) >= t) & (F.col(y) != 1)) / F.count("*") * (t / (1 - t)) for t in thresholds]
    row = F.array(*(F.struct(F.lit(t).alias("threshold"), h.alias("net_benefit")) for t, h in zip(thresholds, hits, strict=True)))
    return df.agg(row.alias("r")).select(F.inline("r"))


def brier(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.avg(d * d).alias("brier"))


def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """(bin, n, mean_y, mean_p) over equal-width bins, 1 falling into the last one; empty bins are left out."""
    cell = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(cell.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("mean_y"), F.avg(p).alias("mean_p"))


def calibration_errors(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("mean_y") - F.col("mean_p"))
    return bins.agg(F.avg(gap).alias("mean_calibration_error"), (F.sum(gap * F.col("n")) / F.sum("n")).alias("expected_calibration_error"))


def hosmer_lemeshow(df: DataFrame, y: str, p: str, n_groups: int = 10) -> DataFrame:
    """(statistic, df) over right-closed exact quantile groups; equal edges raise."""
    edges = df.agg(F.percentile(p, F.array(*(F.lit(k / n_groups) for k in range(n_groups + 1))))).first()[0]
    if edges is None or len(set(edges)) < len(edges):
        raise ValueError("tied scores leave no room for the risk groups")
    group = sum(((F.col(p) > e).cast("int") for e in edges[1:-1]), F.lit(0))
    g = df.groupBy(group.alias("g")).agg(F.sum(F.col(y).cast("double")).alias("o"), F.sum(p).alias("e"), F.count("*").alias("n"))
    part = lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0)
    o, e, n = F.col("o"), F.col("e"), F.col("n")
    return g.agg(F.sum(part(o, e) + part(n - o, n - e)).alias("statistic"), F.lit(n_groups - 2).alias("df"))


def hosmer_lemeshow_p(df: DataFrame, y: str, p: str, n_groups: int = 10) -> float:
    r = hosmer_lemeshow(df, y, p, n_groups).first()
    return chi2_sf(r["statistic"], r["df"])


def spiegelhalter(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, z): observed less expected over the root of the implied variance."""
    q = F.col(p)
    return df.groupBy(*by).agg((F.sum(F.col(y) - q) / F.sqrt(F.sum(q * (1 - q)))).alias("z"))


def placements(df: DataFrame, y: str, p: str, row: str) -> DataFrame:
    """(row, y, v): for each row the share of the other class that its score beats, ties half."""
    n = df.groupBy(F.col(p).alias("s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg"))
    up = running(n, (), "s", {"cp": "pos", "cn": "neg"})
    total_p, total_n = df.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) != 1)).first()
    win = (F.col("cn") - F.col("neg") + F.col("neg") / 2) / total_n
    lose = (F.lit(total_p) - F.col("cp") + F.col("pos") / 2) / total_p
    share = up.select("s", win.alias("win"), lose.alias("lose"))
    return df.join(share, F.col(p) == F.col("s")).select(row, F.col(y).alias("y"), F.when(F.col(y) == 1, F.col("win")).otherwise(F.col("lose")).alias("v"))


def delong(df: DataFrame, y: str, scores: Sequence[str], row: str) -> DataFrame:
    """(score_a, score_b, auc_a, auc_b, variance_a, variance_b, covariance) for every pair of scores, the same one included.

    Placements of the scores meet on the row id; covariances are sample aggregates.
    """
    wide = None
    for k, s in enumerate(scores):
        part = placements(df, y, s, row).withColumnRenamed("v", f"v{k}")
        wide = part if wide is None else wide.join(part.drop("y"), row)
    pairs = [(a, b) for a in range(len(scores)) for b in range(a, len(scores))]
    one = lambda c, on: F.when(F.col("y") == on, F.col(c))
    cells = []
    for a, b in pairs:
        cov = lambda c, d: F.covar_samp(one(c, 1), one(d, 1)) / F.count_if(F.col("y") == 1) + F.covar_samp(one(c, 0), one(d, 0)) / F.count_if(F.col("y") == 0)
        cells.append(F.struct(F.lit(scores[a]).alias("score_a"), F.lit(scores[b]).alias("score_b"), F.avg(one(f"v{a}", 1)).alias("auc_a"), F.avg(one(f"v{b}", 1)).alias("auc_b"), cov(f"v{a}", f"v{a}").alias("variance_a"), cov(f"v{b}", f"v{b}").alias("variance_b"), cov(f"v{a}", f"v{b}").alias("covariance")))
    return wide.agg(F.array(*cells).alias("r")).select(F.inline("r"))


def delong_test(row: dict) -> tuple[float, float]:
    """(z, two-sided p) of a pair that :func:`delong` returned; without any variance a difference is certain."""
    var = row["variance_a"] + row["variance_b"] - 2 * row["covariance"]
    gap = row["auc_a"] - row["auc_b"]
    z = gap / math.sqrt(var) if var > 0 else math.copysign(math.inf, gap) if gap else 0.0
    return z, 2 * normal_sf(abs(z))


def delong_interval(auc_value: float, variance: float, alpha: float = 0.05) -> tuple[float, float]:
    half = normal_ppf(1 - alpha / 2) * math.sqrt(variance)
    return max(0.0, auc_value - half), min(1.0, auc_value + half)


def regression(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """(group, r2, mae, mse, rmse) from sums of one pass and the outcome's variance."""
    d = F.col(y) - F.col(p)
    mse = F.avg(d * d)
    return df.groupBy(*by).agg((1 - F.try_divide(mse, F.var_pop(y))).alias("r2"), F.avg(F.abs(d)).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def bootstrap_auc(df: DataFrame, y: str, p: str, row: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """(round, auc) of stratified resamples: every class keeps its size in expectation by Poisson weights drawn from a hash of row and round.

    Weighted rows never leave their partition before the counting by score, and the
    draw depends on the row alone, so a retried task draws the same sample.
    """
    drawn = df.select(F.col(y).alias("y"), F.col(p).alias("p"), F.col(row).alias("row"), F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = F.pmod(F.xxhash64("row", "round", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    cuts = list(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))
    weight = sum(((u >= c).cast("int") for c in cuts), F.lit(0))
    n = drawn.withColumn("w", weight).where("w > 0").groupBy("round", "p").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") != 1, F.col("w")).otherwise(0)).alias("neg"))
    n = running(n, ("round",), "p", {"upto": "neg"})
    return n.withColumn("won", F.col("pos") * (F.col("upto") - F.col("neg") / 2)).groupBy("round").agg(F.try_divide(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")).where("auc is not null")
