"""Units, their statistics and the features built from them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prep import finite

EPS_RATIO = 1e-8
EPS_TIME = 1e-6
LEAD_SECONDS = 25.0


def statistic(df: DataFrame, by: Sequence[str], features: Sequence[str], name: str = "mean", q: float = 90.0, label: str | None = None) -> DataFrame:
    """Mean, sample deviation or exact percentile of each feature by unit; units labelled 0 are background and go."""
    if label:
        df = df.where(F.col(label) != 0)
    make = {"mean": F.avg, "std": F.stddev_samp, "percentile": lambda x: F.percentile(x, F.lit(q / 100))}[name]
    return df.groupBy(*by).agg(*(make(finite(F.col(f))).alias(f) for f in features))


def units_frame(df: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Rows of a units table: one per group with its size and mean features."""
    return df.groupBy(*by).agg(F.count("*").alias("count"), *(F.avg(finite(F.col(f))).alias(f) for f in features))


def ratio(a: str, b: str, eps: float = EPS_RATIO) -> Column:
    return F.try_divide(F.col(a), F.col(b) + eps)


def difference(a: str, b: str) -> Column:
    return F.col(a) - F.col(b)


def weighted(columns: Mapping[str, float]) -> list[Column]:
    return [(F.col(c) * w).alias(c) for c, w in columns.items()]


def average(columns: Mapping[str, float]) -> Column:
    """Weighted mean with the weights brought to a sum of 1; a zero sum raises."""
    total = sum(columns.values())
    if total == 0:
        raise ValueError("weights add up to zero")
    return sum((F.col(c) * (w / total) for c, w in columns.items()), F.lit(0.0))


def kinetic(phases: Sequence[str], times: Sequence[Column]) -> dict[str, Column]:
    """Wash-in and two later slopes of four phase intensities over their acquisition times (timestamps).

    The unenhanced time is the arterial one less a fixed lead; a drop after contrast
    counts as no enhancement.
    """
    plain, arterial, portal, delayed = (F.col(p).cast("double") for p in phases)
    seconds = [F.unix_micros(t.cast("timestamp")) / F.lit(1e6) for t in times]
    wash_in = F.greatest(arterial - plain, F.lit(0.0)) / (F.lit(LEAD_SECONDS) + EPS_TIME)
    return {
        "wash_in_slope": wash_in,
        "wash_out_slope_early": (portal - arterial) / (seconds[2] - seconds[1] + EPS_TIME),
        "wash_out_slope_late": (delayed - portal) / (seconds[3] - seconds[2] + EPS_TIME),
    }


def local_entropy(voxels: DataFrame, subject: str, value: str, size: int = 3, bins: int = 32) -> DataFrame:
    """(subject, z, y, x, entropy) in bits over the box around each voxel row.

    Intensities are scaled over the subject and rounded half to even into bins; counts
    are divided by the whole box, also at borders.  Voxels are exchanged once, and boxes
    are read where their subject lies (see :mod:`.slabs`).
    """
    from . import slabs

    reach = size // 2
    per = Window.partitionBy(subject)
    low, high = F.min(value).over(per), F.max(value).over(per)
    level = F.when(high > low, F.rint((F.col(value) - low) / (high - low) * (bins - 1))).otherwise(F.lit(0.0)).cast("int")
    levels = voxels.select(subject, "z", "y", "x", level.alias("level"))
    around = range(-reach, reach + 1)
    offsets = [(a, b, c) for a in around for b in around for c in around]
    whole = float(len(offsets))

    def run(batches: Iterator) -> Iterator:
        for b in slabs.stream(batches, [subject], ["level"], max(reach, 1)):
            own = np.flatnonzero(b.own & ~b.alone[b.g])
            found = b.values["level"]
            found = np.where(found == slabs.NONE, bins, found)  # a missing value is a level of its own
            count = np.zeros(len(found) * (bins + 1), np.int64)
            for o in offsets:
                x, y = b.pairs(o, b.own)
                count += np.bincount(x * (bins + 1) + found[y], minlength=len(count))
            p = count.reshape(-1, bins + 1)[own] / whole
            entropy = -(p * np.log2(p, out=np.zeros(p.shape), where=p > 0)).sum(1)
            yield slabs.rows_of(b, b.g[own], {k: a[own].astype(np.int32) for k, a in zip(slabs.KEY, b.at, strict=True)} | {"entropy": entropy})

    return slabs.by_region(levels, [subject], ["level"], run, "z int, y int, x int, entropy double")


def first_order(df: DataFrame, by: Sequence[str], value: str, bin_width: float = 25.0, cell_volume: float = 1.0) -> DataFrame:
    """The first-order features of each group by two aggregations and a histogram.

    Levels are ``floor(x / width) - floor(min / width) + 1``; entropy and uniformity
    are over their shares; moments use population forms, kurtosis is not reduced.
    """
    x = finite(F.col(value))
    rows = df.select(*by, x.alias("x")).where("x is not null")
    base = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("energy"), F.min("x").alias("minimum"), F.max("x").alias("maximum"), F.avg("x").alias("mean"),
        F.percentile("x", F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)))).alias("q"),
    )
    d = F.col("x") - F.col("mean")
    near = (F.col("x") >= F.col("q")[0]) & (F.col("x") <= F.col("q")[4])
    moments = (
        rows.join(base, list(by))
        .groupBy(*by)
        .agg(F.avg(F.abs(d)).alias("mad"), F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"), F.avg(F.when(near, F.col("x"))).alias("near_mean"))
    )
    robust = rows.join(base, list(by)).join(moments, list(by)).groupBy(*by).agg(F.avg(F.when(near, F.abs(F.col("x") - F.col("near_mean")))).alias("robust_mad"))
    level = rows.groupBy(*by, F.floor(F.col("x") / bin_width).alias("level")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*by))
    p = F.col("p")
    shape = level.withColumn("p", F.col("c") / total).groupBy(*by).agg(F.sum(-p * F.log2(p + 2.2e-16)).alias("entropy"), F.sum(p * p).alias("uniformity"))
    out = base.join(moments, list(by)).join(robust, list(by)).join(shape, list(by))
    q = F.col("q")
    m2 = F.col("m2")
    return out.select(
        *by, "energy", (F.col("energy") * cell_volume).alias("total_energy"), "entropy", "minimum", q[0].alias("percentile_10"), q[4].alias("percentile_90"), "maximum", "mean", q[2].alias("median"),
        (q[3] - q[1]).alias("interquartile_range"), (F.col("maximum") - F.col("minimum")).alias("range"), F.col("mad").alias("mean_absolute_deviation"), F.col("robust_mad").alias("robust_mean_absolute_deviation"),
        F.sqrt(F.col("energy") / F.col("n")).alias("root_mean_squared"), F.sqrt(m2).alias("standard_deviation"),
        F.when(m2 > 0, F.col("m3") / F.pow(m2, 1.5)).otherwise(0.0).alias("skewness"), F.when(m2 > 0, F.col("m4") / (m2 * m2)).otherwise(0.0).alias("kurtosis"), m2.alias("variance"), "uniformity",
    )
