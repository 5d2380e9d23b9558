"""Texture matrices and their features over label maps.

Rows are cells (groups, z, y, x, level) of one region each.  Matrices are made in one
exchange of the cells, a region's in one task that reads it slice by slice (see
:mod:`.slabs`).  A matrix is a table of counts, and every feature is an aggregate over
that table; :func:`features` makes both in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import regional, slabs

EPS = 2.2e-16


def discretise(df: DataFrame, by: Sequence[str], value: str, bin_width: float) -> DataFrame:
    """The rows with ``level``: ``floor(x / width)`` less the group's smallest, plus 1."""
    raw = F.floor(F.col(value) / bin_width)
    return df.withColumn("level", (raw - F.min(raw).over(Window.partitionBy(*by)) + 1).cast("int"))


def glcm(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(groups, direction, i, j, n): levels of neighbouring cells of a region along each of the 13 directions, both ways, hence symmetric.

    Only one of each two opposite offsets is joined; the other is its mirror image.
    A direction without a pair has no rows.
    """
    def made(b, found):
        g, direction, i, j, n = found["pairs"]
        return slabs.rows_of(b, g, {"direction": direction.astype("int32"), "i": slabs.levels_out(i), "j": slabs.levels_out(j), "n": n})

    return _table(cells, by, "pairs", made, "direction int, i int, j int, n long")


def _table(cells: DataFrame, by: Sequence[str], name: str, made: Callable, schema: str, step: tuple[Callable, int] | None = None) -> DataFrame:
    """A table of counts of every region, each made whole by one task (see :mod:`.slabs`)."""
    keys = list(by)
    steps = {name: step} if step else {name: regional.steps(regional.NEEDS, "level")[name]}

    def run(batches: Iterator) -> Iterator:
        for b, found in slabs.tables(batches, keys, ["level"], steps):
            yield made(b, found)

    return slabs.by_region(cells, keys, ["level"], run, schema)


def features(cells: DataFrame, by: Sequence[str], family: str) -> DataFrame:
    """(groups, features) of one family, made where its table is; regions without a row of the table are left out."""
    keys = list(by)
    steps = regional.steps([family], "level")
    names = ("mcc",) if family == "mcc" else regional.NAMES[family]

    def run(batches: Iterator) -> Iterator:
        for b, found in slabs.tables(batches, keys, ["level"], steps):
            made = slabs.rows_of(b, np.arange(b.n), regional.features(b.n, b.alone, found, [family], 1.0, prefix=False))
            yield made.filter(pc.is_valid(made.column(names[0])))

    return slabs.by_region(cells, keys, ["level"], run, ", ".join(f"{n} double" for n in names))


def _entropy(p: Column) -> Column:
    return F.sum(-p * F.log2(p + EPS))


def glcm_features(matrix: DataFrame, by: Sequence[str], levels: DataFrame | None = None) -> DataFrame:
    """Co-occurrence features: each of every direction's own normalised table, then averaged over the region's directions.

    The number of levels is the region's largest level, taken from ``levels`` (groups,
    level, any number of rows) where given and else from the matrix.  The table is
    exchanged once; marginals, diagonals and means are windows within it.
    """
    keys = list(by)
    each = [*keys, "direction"]
    rows = matrix.repartition(*(F.col(k) for k in each))
    over = lambda *more: Window.partitionBy(*each, *more)
    d, s = F.col("i") - F.col("j"), F.col("i") + F.col("j")
    q = F.col("p")
    rows = rows.withColumn("p", F.col("n") / F.sum("n").over(over())).withColumns({"away": F.abs(d), "total": s})
    rows = rows.withColumns({"px": F.sum("p").over(over("i")), "py": F.sum("p").over(over("j")), "pd": F.sum("p").over(over("away")), "ps": F.sum("p").over(over("total")), "mu": F.sum(F.col("i") * q).over(over()), "mean_away": F.sum(F.col("away") * q).over(over())})
    if levels is None:
        levels = matrix.select(*keys, F.col("i").alias("level"))
    top = levels.groupBy(*keys).agg(F.max("level").cast("double").alias("ng"))
    rows = rows.join(top, keys)
    i, j, d, k, n, mu = (F.col(x).cast("double") for x in ("i", "j", "away", "away", "ng", "mu"))
    c = i + j - 2 * mu
    # an entropy of a marginal or diagonal, summed over the cells that it collects
    information = lambda x: F.sum(-q * F.log2(x + EPS))
    main = rows.groupBy(*each).agg(
        F.sum(i * j * q).alias("autocorrelation"), F.first("mu").alias("joint_average"), F.sum(c * c * c * c * q).alias("cluster_prominence"), F.sum(c * c * c * q).alias("cluster_shade"), F.sum(c * c * q).alias("cluster_tendency"),
        F.sum(d * d * q).alias("contrast"), F.sum((i - mu) * (j - mu) * q).alias("__cov"), F.sum((i - mu) * (i - mu) * q).alias("sum_squares"), F.sum(k * q).alias("difference_average"), information(F.col("pd")).alias("difference_entropy"),
        F.sum((k - F.col("mean_away")) * (k - F.col("mean_away")) * q).alias("difference_variance"), F.sum(q * q).alias("joint_energy"), information(q).alias("joint_entropy"), F.sum(q / (1 + d * d)).alias("idm"), F.sum(q / (1 + d * d / (n * n))).alias("idmn"), F.sum(q / (1 + d)).alias("id"), F.sum(q / (1 + d / n)).alias("idn"),
        F.sum(F.when(d != 0, q / (d * d)).otherwise(0.0)).alias("inverse_variance"), F.max(q).alias("maximum_probability"), F.sum((i + j) * q).alias("sum_average"), information(F.col("ps")).alias("sum_entropy"),
        information(F.col("px")).alias("__hx"), information(F.col("px") * F.col("py")).alias("__hxy1"),
    )
    var, hx, h = F.col("sum_squares"), F.col("__hx"), F.col("joint_entropy")
    # a table is symmetric, so both marginals have one entropy and their product has twice that
    own = {
        "correlation": F.when(var > 0, F.col("__cov") / (var + EPS)).otherwise(1.0),
        "imc1": F.when(hx != 0, (h - F.col("__hxy1")) / F.when(hx != 0, hx)).otherwise(0.0),
        "imc2": F.sqrt(F.greatest(1 - F.exp(-2 * (2 * hx - h)), F.lit(0.0))),
    }
    main = main.withColumns(own)
    return main.groupBy(*keys).agg(*(F.avg(x).alias(x) for x in main.columns if x not in each and not x.startswith("__")))


def maximal_correlation(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    """(groups, mcc): the root of the second largest eigenvalue of the levels' transition products, averaged over directions.

    The levels are all of the region's; a region of one level has 1.  A group's table
    has at most 13 times the square of its levels, so one task holds it.
    """
    import numpy as np
    import pandas as pd

    keys = list(by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        found = []
        for _, own in pdf.groupby("direction"):
            p = np.zeros((len(levels), len(levels)))
            np.add.at(p, (np.searchsorted(levels, own["i"]), np.searchsorted(levels, own["j"])), own["n"])
            p /= p.sum()
            px, py = p.sum(1), p.sum(0)
            q = np.einsum("ik,jk,ik->ij", p, p, 1 / (px[:, None] * py[None] + EPS))
            values = np.sort(np.linalg.eigvals(q).real)
            found.append(float(np.sqrt(max(values[-2], 0.0))) if len(values) > 1 else 1.0)
        return pdf[keys].head(1).assign(mcc=float(np.mean(found)))

    kinds = ", ".join(f"{k} {matrix.schema[k].dataType.simpleString()}" for k in keys)
    return matrix.groupBy(*keys).applyInPandas(run, f"{kinds}, mcc double")


def gldm(cells: DataFrame, by: Sequence[str], alpha: int = 0) -> DataFrame:
    """(groups, level, size, n): cells by level and by how many neighbours, itself included, differ by at most alpha."""
    return _table(cells, by, "dependence", _sized("dependence"), "level int, size int, n long", (regional.dependence(alpha), 3))


def _sized(name: str) -> Callable:
    def made(b, found):
        g, level, size, n = found[name]
        return slabs.rows_of(b, g, {"level": slabs.levels_out(level), "size": size.astype("int32"), "n": n})

    return made


def glszm(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(groups, level, size, n): zones of equal level, joined through all 26 neighbours, by size."""
    return _table(cells, by, "zones", _sized("zones"), "level int, size int, n long")


def glrlm(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(groups, direction, level, size, n): runs of equal level along the 13 directions."""

    def made(b, found):
        g, direction, level, size, n = found["runs"]
        return slabs.rows_of(b, g, {"direction": direction.astype("int32"), "level": slabs.levels_out(level), "size": size.astype("int32"), "n": n})

    return _table(cells, by, "runs", made, "direction int, level int, size int, n long")


def size_features(matrix: DataFrame, by: Sequence[str], cells_per_group: DataFrame | None = None) -> DataFrame:
    """Features shared by run, zone and dependence tables (groups, level, size, n).

    ``percentage`` divides by the group's cells (groups, cells) where they are given.
    """
    keys = list(by)
    g, s, n = F.col("level").cast("double"), F.col("size").cast("double"), F.col("n").cast("double")
    total = F.sum(n)
    p = n / F.sum("n").over(Window.partitionBy(*keys))
    rows = matrix.withColumn("p", p)
    q = F.col("p")
    mean = lambda x: F.sum(x * n) / total
    main = rows.groupBy(*keys).agg(
        mean(1 / (s * s)).alias("small_emphasis"), mean(s * s).alias("large_emphasis"), mean(1 / (g * g)).alias("low_level_emphasis"), mean(g * g).alias("high_level_emphasis"),
        mean(1 / (s * s * g * g)).alias("small_low_emphasis"), mean(g * g / (s * s)).alias("small_high_emphasis"), mean(s * s / (g * g)).alias("large_low_emphasis"), mean(s * s * g * g).alias("large_high_emphasis"),
        (mean(g * g) - mean(g) * mean(g)).alias("level_variance"), (mean(s * s) - mean(s) * mean(s)).alias("size_variance"), _entropy(q).alias("size_entropy"), total.alias("__n"),
    )
    by_level = matrix.groupBy(*keys, "level").agg(F.sum("n").alias("m")).groupBy(*keys).agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("level_nonuniformity"))
    by_size = matrix.groupBy(*keys, "size").agg(F.sum("n").alias("m")).groupBy(*keys).agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("size_nonuniformity"))
    out = main.join(by_level, keys).join(by_size, keys)
    out = out.withColumns({f"{k}_normalized": F.col(k) / F.col("__n") for k in ("level_nonuniformity", "size_nonuniformity")})
    if cells_per_group is not None:
        out = out.join(cells_per_group, keys).withColumn("percentage", F.col("__n") / F.col("cells")).drop("cells")
    return out.drop("__n")


def ngtdm(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(groups, level, n, s): cells with a neighbour in the region by level, and their summed distance from the neighbours' mean."""

    def made(b, found):
        g, level, n, away = found["beside"]
        return slabs.rows_of(b, g, {"level": slabs.levels_out(level), "n": n, "s": away})

    return _table(cells, by, "beside", made, "level int, n long, s double")


def ngtdm_features(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coarseness, contrast, busyness, complexity and strength; level pairs are joined within a group (levels are few)."""
    keys = list(by)
    rows = table.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    a, b = (rows.select(*keys, *(F.col(c).alias(f"{c}{t}") for c in ("level", "n", "s", "p"))) for t in "ab")
    i, j, pa, pb, sa, sb = (F.col(c).cast("double") for c in ("levela", "levelb", "pa", "pb", "sa", "sb"))
    d = i - j
    pairs = a.join(b, keys).groupBy(*keys).agg(
        F.sum(pa * pb * d * d).alias("__c"), F.sum(F.abs(i * pa - j * pb)).alias("__b"), F.sum(F.abs(d) * (pa * sa + pb * sb) / (pa + pb)).alias("__x"), F.sum((pa + pb) * d * d).alias("__t"),
    )
    one = rows.groupBy(*keys).agg(F.sum(F.col("p") * F.col("s")).alias("__ps"), F.sum("s").alias("__s"), F.sum("n").alias("__n"), F.count("*").alias("__g"))
    out = one.join(pairs, keys)
    ps, s, n, g = (F.col(c).cast("double") for c in ("__ps", "__s", "__n", "__g"))
    return out.select(
        *keys, F.when(ps > 0, F.least(1 / ps, F.lit(1e6))).otherwise(1e6).alias("coarseness"), F.when(g > 1, F.col("__c") / (g * (g - 1)) * s / n).otherwise(0.0).alias("contrast"),
        F.coalesce(F.try_divide(ps, F.col("__b")), F.lit(0.0)).alias("busyness"), (F.col("__x") / n).alias("complexity"), F.coalesce(F.try_divide(F.col("__t"), s), F.lit(0.0)).alias("strength"),
    )
