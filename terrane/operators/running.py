"""Running sums over an order, without a task that holds all rows.

Values are cut at quantile edges into ranges; a window sums within a group's range, and
the ranges' totals, a few rows, are summed once more and added.  Tables of up to
``SINGLE`` rows are summed by one window a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Rows up to which one window a group does.
SINGLE = 200_000
RANGES = 256


def running(df: DataFrame, by: Sequence[str], order: str, sums: Mapping[str, str], descending: bool = False, single: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` (new name: summed column): its sum over the group's rows up to and with this one by ``order``.

    ``order`` is numeric and, within a group, without repeats; nulls come first, also when descending.
    """
    single = SINGLE if single is None else single
    df = cut(df)
    up = F.col(order).desc_nulls_first() if descending else F.col(order).asc_nulls_first()
    upto = lambda *keys: Window.partitionBy(*keys).orderBy(up).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if df.count() <= single:
        return df.select("*", *(F.sum(c).over(upto(*by)).alias(name) for name, c in sums.items()))
    edges = sorted(set(df.approxQuantile(order, [k / RANGES for k in range(1, RANGES)], 0.25 / RANGES)))
    at = F.coalesce(F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col(order))), F.lit(-1))
    placed = df.withColumn("__range", -at if descending else at)
    if descending:
        placed = placed.withColumn("__range", F.when(F.col(order).isNull(), F.lit(-len(edges) - 1)).otherwise(F.col("__range")))
    total = placed.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__{name}") for name, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*by, "__range", *(F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums))
    inside = placed.select("*", *(F.sum(c).over(upto(*by, "__range")).alias(name) for name, c in sums.items()))
    joined = inside.alias("a").join(total.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*by, "__range")])
    return joined.select(*(F.col(f"a.{c}").alias(c) for c in df.columns), *((F.col(f"a.{name}") + F.col(f"b.__{name}")).alias(name) for name in sums))
