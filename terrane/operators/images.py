"""Intensity images as cells (keys, z, y, x, value): scaling, standardisation, geometry and perturbation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import KEY, _shifted, half_offsets

#: Landmark percentiles of histogram standardisation: the ends and the deciles.
LANDMARKS = (1, 10, 20, 30, 40, 50, 60, 70, 80, 90, 99)
AXES = {"L": ("x", 1), "R": ("x", -1), "P": ("y", 1), "A": ("y", -1), "S": ("z", 1), "I": ("z", -1)}


def zscore(cells: DataFrame, by: Sequence[str], value: str, mask: str | None = None, clip: tuple[float, float] | None = None, eps: float = 1e-8) -> DataFrame:
    """The rows with the value scaled by its group's mean and population deviation, both over the mask where one is named."""
    x = F.col(value).cast("double")
    seen = F.when(F.col(mask) != 0, x) if mask else x
    w = Window.partitionBy(*by)
    std = F.stddev_pop(seen).over(w)
    out = (x - F.avg(seen).over(w)) / F.when(std < eps, 1.0).otherwise(std)
    if clip:
        out = F.least(F.greatest(out, F.lit(float(clip[0]))), F.lit(float(clip[1])))
    return cells.withColumn(value, out)


def landmarks(cells: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[float] = LANDMARKS) -> DataFrame:
    """(group, marks): exact percentiles of the positive values."""
    seen = F.when(F.col(value) > 0, F.col(value).cast("double"))
    return cells.groupBy(*by).agg(F.percentile(seen, F.array(*(F.lit(p / 100) for p in percentiles))).alias("marks"))


def standardise(cells: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[float] = LANDMARKS, low: float = 0.0, high: float = 100.0) -> DataFrame:
    """The rows with the value mapped piece by piece from its group's landmarks to evenly placed ones; below and above, the end pieces go on."""
    span = percentiles[-1] - percentiles[0]
    target = [low + (p - percentiles[0]) / span * (high - low) for p in percentiles]
    joined = cells.join(landmarks(cells, by, value, percentiles), list(by))
    x, m = F.col(value).cast("double"), F.col("marks")
    last = len(percentiles) - 1

    def piece(k: int) -> Column:
        width = m[k + 1] - m[k]
        slope = F.lit(target[k + 1] - target[k]) / width
        flat = F.lit(target[-1] if k == last - 1 else (target[k] + target[k + 1]) / 2)
        return F.when(width > 0, x * slope + (F.lit(target[k]) - slope * m[k])).otherwise(flat)

    out = F.when(x <= m[0], F.when(m[0] != 0, x * F.lit(target[0]) / m[0]).otherwise(x))
    for k in range(last):
        out = out.when(x <= m[k + 1], piece(k))
    return joined.withColumn(value, out.otherwise(piece(last - 1))).drop("marks")


def reorient(cells: DataFrame, by: Sequence[str], source: str, target: str) -> DataFrame:
    """The cells with axes permuted and flipped from one orientation code to another (letters for x, y, z)."""
    axes = ("x", "y", "z")
    at = {AXES[c][0]: (axes[k], AXES[c][1]) for k, c in enumerate(source)}
    w = Window.partitionBy(*by)
    cols = {}
    for k, c in enumerate(target):
        world, sign = AXES[c]
        axis, own = at[world]
        cols[axes[k]] = F.col(axis) if own == sign else F.max(axis).over(w) + F.min(axis).over(w) - F.col(axis)
    return cells.select(*(c for c in cells.columns if c not in axes), *(v.cast("int").alias(k) for k, v in cols.items()))


def resample_nearest(cells: DataFrame, by: Sequence[str], spacing: Sequence[float], target: Sequence[float]) -> DataFrame:
    """The cells on a grid of another spacing (z, y, x), each new cell taking the closest old one.

    An old cell computes the range of new cells that it is closest to, so nothing is joined.
    """
    out = cells
    for axis, old, new in zip(KEY, spacing, target, strict=True):
        first = F.ceil((F.col(axis) - 0.5) * old / new)
        end = F.ceil((F.col(axis) + 0.5) * old / new) - 1
        out = out.withColumn("__r", F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))).withColumn(axis, F.explode("__r")).drop("__r").withColumn(axis, F.col(axis).cast("int"))
    return out.where(" and ".join(f"{a} >= 0" for a in KEY))


def resample_linear(cells: DataFrame, by: Sequence[str], value: str, spacing: Sequence[float], target: Sequence[float]) -> DataFrame:
    """The image on a grid of another spacing (z, y, x) with linear weights, one axis after the other; the first cells of both grids lie on each other.

    An old cell sends its weighted value to the new places within a step of it, which are
    added up slice by slice where the group lies.  What lies beyond the old grid's last
    cell isn't made, and a missing old cell counts as 0.
    """
    out = cells.select(*by, *KEY, F.col(value).cast("double").alias(value))
    for axis, old, new in zip(KEY, spacing, target, strict=True):
        if old != new:
            out = _stretched(out, list(by), value, axis, float(old), float(new))
    return out


def _stretched(cells: DataFrame, by: list[str], value: str, axis: str, old: float, new: float) -> DataFrame:
    from . import slabs

    # slices lie across another axis, so that each holds whole lines along this one
    order = ["y", "z", "x"] if axis == "z" else list(KEY)
    rows = cells.select(*by, *(F.col(a).alias(k) for a, k in zip(order, KEY, strict=True)), F.col(value).alias("__v"), F.max(axis).over(Window.partitionBy(*by)).alias("__last"))
    line = order.index(axis)

    def run(batches: Iterator) -> Iterator:
        for b in slabs.stream(batches, by, ["__v", "__last"]):
            own = np.flatnonzero(b.own)
            at = b.at[line][own]
            first = np.floor((at - 1) * old / new + 1 + 1e-9).astype(np.int64)
            end = (np.ceil((at + 1) * old / new - 1e-9) - 1).astype(np.int64)
            n = np.maximum(end - first + 1, 0)
            who = np.repeat(np.arange(len(own)), n)
            to = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keep = (to >= 0) & (to * new <= b.values["__last"][own][who] * old + 1e-9)
            who, to = who[keep], to[keep]
            cell = own[who]
            part = b.values["__v"][cell] * (1 - np.abs(to * new / old - b.at[line][cell]))
            there = ~np.isnan(part)
            places = [a[cell] for a in b.at]
            places[line] = to
            g, *found, total, known = slabs.summed([b.g[cell], *places], np.where(there, part, 0.0), there.astype(np.int64))
            named = dict(zip(order, found, strict=True))
            yield slabs.rows_of(b, g, {k: named[k].astype(np.int32) for k in KEY} | {value: pa.array(total, mask=known == 0)})

    return slabs.by_region(rows, by, ["__v", "__last"], run, f"z int, y int, x int, `{value}` double")


def equalise(cells: DataFrame, by: Sequence[str], value: str, tile: int = 32, bins: int = 256, clip: float = 0.01) -> DataFrame:
    """Contrast-limited adaptive histogram equalisation: each cell's value becomes its share in the clipped histograms of the tiles around it, mixed linearly.

    Values are binned over the group's range; a bin's count is clipped at ``clip`` of its
    tile's cells and the excess spread evenly over the bins.  Tiles are boxes of ``tile``
    cells to a side in the plane, slice by slice; results lie between 0 and 1, a group
    of one value gets 0.
    """
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    level = F.when(high > low, F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(0)
    rows = cells.withColumn("__b", level.cast("int")).withColumn("__flat", high == low)
    place = [F.floor(F.col(a) / tile).cast("int").alias(f"t{a}") for a in ("y", "x")]
    own = [*by, "z", "ty", "tx"]
    counts = rows.select(*by, "z", *place, "__b").groupBy(*own, "__b").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*own))
    most = F.greatest(F.lit(1.0), total * clip)
    clipped = counts.withColumns({"__total": total, "__kept": F.least(F.col("n").cast("double"), most)})
    # the share below and within a bin: clipped counts of the bins up to it, and its part of the excess
    table = clipped.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("__b", "__kept"))).alias("__h"), F.first("__total").alias("__total"))
    table = table.withColumn("__spare", F.col("__total") - F.aggregate("__h", F.lit(0.0), lambda s, x: s + x["__kept"]))
    beside = rows
    for a in ("y", "x"):
        at = (F.col(a) + 0.5) / tile - 0.5
        below = F.floor(at)
        ends = F.array(F.struct(below.cast("int").alias("t"), (1 - (at - below)).alias("w")), F.struct((below + 1).cast("int").alias("t"), (at - below).alias("w")))
        beside = beside.withColumn(f"__{a}", F.explode(F.filter(ends, lambda e: e["w"] > 0)))
    asked = beside.select(*by, *KEY, "__b", "__flat", F.col("__y.t").alias("ty"), F.col("__x.t").alias("tx"), (F.col("__y.w") * F.col("__x.w")).alias("__w"))
    met = asked.join(table, own)
    share = (F.aggregate(F.filter("__h", lambda x: x["__b"] <= F.col("__b")), F.lit(0.0), lambda s, x: s + x["__kept"]) + F.col("__spare") * (F.col("__b") + 1) / bins) / F.col("__total")
    # tiles without a cell say nothing, and the others' weights count the more
    out = met.withColumn("__s", share).groupBy(*by, *KEY).agg((F.sum(F.col("__w") * F.col("__s")) / F.sum("__w")).alias("__v"), F.first("__flat").alias("__flat"))
    return out.select(*by, *KEY, F.when(F.col("__flat"), 0.0).otherwise(F.col("__v")).alias(value))


def noise_sigma(cells: DataFrame, by: Sequence[str], value: str) -> float:
    """The noise level of an image: the median absolute diagonal difference of two-by-two squares in the plane, halved and scaled to a normal's deviation (0 without a square).

    The squares are the finest diagonal details of the Haar wavelet; squares with a missing cell are left out.
    """
    corner = F.struct(F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).alias("__c")
    sign = F.when((F.col("y") + F.col("x")) % 2 == 0, 1).otherwise(-1)
    squares = cells.groupBy(*by, "z", corner).agg(F.sum(F.col(value) * sign).alias("d"), F.count(value).alias("n")).where("n = 4")
    found = squares.agg(F.percentile(F.abs("d") / 2, F.lit(0.5))).first()[0]
    return 0.0 if found is None else float(found) / 0.6745


def _offsets(connectivity: int) -> list[tuple[int, int, int]]:
    half = half_offsets({1: "face", 2: "edge", 3: "corner"}[connectivity])
    return half + [(-a, -b, -c) for a, b, c in half]


def erode(cells: DataFrame, by: Sequence[str], steps: int = 1, connectivity: int = 1) -> DataFrame:
    """The labelled cells whose neighbours all have their label, repeatedly; what lies outside the map doesn't count as label."""
    offsets = _offsets(connectivity)
    out = cells.where("label <> 0").select(*by, *KEY, "label")
    for _ in range(steps):
        near = _shifted(out, offsets, [*by, "label"]).join(out, [*by, *KEY, "label"]).groupBy(*by, *KEY, "label").agg(F.count("*").alias("__n"))
        out = near.where(F.col("__n") == len(offsets)).drop("__n")
    return out


def dilate(cells: DataFrame, by: Sequence[str], steps: int = 1, connectivity: int = 1) -> DataFrame:
    """The labelled cells and those within so many steps of them; a new cell takes the label that reached it first, of several the smallest."""
    out = cells.where("label <> 0").select(*by, *KEY, "label")
    for _ in range(steps):
        reached = _shifted(out, _offsets(connectivity), [*by, "label"]).groupBy(*by, *KEY).agg(F.min("label").alias("label"))
        out = out.unionByName(reached.join(out, [*by, *KEY], "left_anti"))
    return out


def boundary(cells: DataFrame, by: Sequence[str], steps: int = 1, connectivity: int = 1) -> DataFrame:
    """Cells (keys, z, y, x) within so many steps of the surface, inside or outside."""
    one = cells.where("label <> 0").select(*by, *KEY, F.lit(1).alias("label"))
    return dilate(one, by, steps, connectivity).select(*by, *KEY).exceptAll(erode(one, by, steps, connectivity).select(*by, *KEY))


def slice_extent(cells: DataFrame, by: Sequence[str], shrink: int = 0, grow: int = 0) -> DataFrame:
    """The map without its outer slices, or with its end slices repeated outwards."""
    w = Window.partitionBy(*by)
    rows = cells.where("label <> 0").withColumn("__a", F.min("z").over(w)).withColumn("__b", F.max("z").over(w))
    kept = rows.where((F.col("z") >= F.col("__a") + shrink) & (F.col("z") <= F.col("__b") - shrink))
    if not grow:
        return kept.drop("__a", "__b")
    step = F.explode(F.sequence(F.lit(1), F.lit(grow)))
    low = rows.where("z = __a").withColumn("__s", step).withColumn("z", (F.col("z") - F.col("__s")).cast("int")).drop("__s")
    high = rows.where("z = __b").withColumn("__s", step).withColumn("z", (F.col("z") + F.col("__s")).cast("int")).drop("__s")
    return kept.unionByName(low).unionByName(high).drop("__a", "__b")


def gaussian_noise(cells: DataFrame, by: Sequence[str], value: str, sigma: float, seed: int = 0, whole: bool = False) -> DataFrame:
    """The rows with noise of the given deviation added; a cell's draw is a hash of its place, the same on every attempt."""
    u = lambda k: (F.pmod(F.xxhash64(*by, *KEY, F.lit(seed * 2 + k)), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)
    normal = F.sqrt(-2 * F.ln(u(0))) * F.cos(2 * 3.141592653589793 * u(1))
    out = F.col(value) + normal * sigma
    return cells.withColumn(value, F.rint(out) if whole else out)


def translate(cells: DataFrame, by: Sequence[str], value: str, shift: Sequence[float]) -> DataFrame:
    """The image moved by a part of a voxel with linear weights; what comes from outside counts as 0.

    Each cell asks the (at most eight) cells around the place it comes from, where its group lies.
    """
    from . import slabs

    keys = list(by)
    whole = [int(s // 1) for s in shift]
    part = [s - w for s, w in zip(shift, whole, strict=True)]
    moves = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    weight = lambda o: float((part[0] if o[0] else 1 - part[0]) * (part[1] if o[1] else 1 - part[1]) * (part[2] if o[2] else 1 - part[2]))
    parts = [(tuple(-(w + d) for w, d in zip(whole, o, strict=True)), weight(o)) for o in moves if weight(o) > 0]
    reach = max(1, *(abs(c) for o, _ in parts for c in o))

    def run(batches: Iterator) -> Iterator:
        for b in slabs.stream(batches, keys, ["__v"], reach):
            v, n = b.values["__v"], len(b.g)
            out, met, known = np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
            for o, w in parts:
                x, y = b.pairs(o, b.own)
                met[x] = True
                there = ~np.isnan(v[y])
                x, y = x[there], y[there]
                known[x] = True
                out += np.bincount(x, v[y] * w, n)
            rows = np.flatnonzero(met)
            yield slabs.rows_of(b, b.g[rows], {k: a[rows].astype(np.int32) for k, a in zip(KEY, b.at, strict=True)} | {value: pa.array(out[rows], mask=~known[rows])})

    rows = cells.select(*keys, *KEY, F.col(value).cast("double").alias("__v"))
    return slabs.by_region(rows, keys, ["__v"], run, f"z int, y int, x int, `{value}` double")


def rigid(cells: DataFrame, by: Sequence[str], value: str, degrees: float = 0.0, shift: Sequence[float] = (0.0, 0.0, 0.0), axis: str = "z") -> DataFrame:
    """The image turned about the centre of its group's box and moved, in one resampling with linear weights; what comes from outside counts as 0.

    Every cell asks the (at most eight) cells around the place it comes from, where its
    group lies: slices are taken across the axis, so a turn stays in its slice.  Places
    are rounded at nine digits so that a turn by nothing asks one cell only.
    """
    import math

    from . import slabs

    keys = list(by)
    turned = [k for k in KEY if k != axis]
    c, d = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    w = Window.partitionBy(*by)
    middle = {k: (F.max(k).over(w) + F.min(k).over(w)) / 2 for k in KEY}
    off = {k: F.col(k) - F.lit(float(s)) - middle[k] for k, s in zip(KEY, shift, strict=True)}
    a, b = turned
    source = {axis: off[axis], a: off[a] * c + off[b] * d, b: off[b] * c - off[a] * d}
    order = [axis, *turned]
    rows = cells.select(*keys, *(F.col(k).alias(n) for k, n in zip(order, KEY, strict=True)), F.col(value).cast("double").alias("__v"), *(F.round(source[k] + middle[k], 9).alias(f"__{n}") for k, n in zip(order, KEY, strict=True)))
    names = ["__v", *(f"__{n}" for n in KEY)]
    reach = max(1, math.ceil(abs(shift[KEY.index(axis)])) + 1)

    def run(batches: Iterator) -> Iterator:
        for b in slabs.stream(batches, keys, names, reach):
            own, v, n = np.flatnonzero(b.own), b.values["__v"], len(b.g)
            out = np.zeros(n)
            low = [np.floor(b.values[f"__{k}"][own]) for k in KEY]
            part = [b.values[f"__{k}"][own] - p for k, p in zip(KEY, low, strict=True)]
            for o in ((i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)):
                weight = np.prod([p if e else 1 - p for e, p in zip(o, part, strict=True)], axis=0)
                asks = np.flatnonzero(weight > 0)
                all_weights = np.zeros(n)
                all_weights[own] = weight
                x, y = b.places(own[asks], [(p[asks] + e).astype(np.int64) for e, p in zip(o, low, strict=True)])
                there = ~np.isnan(v[y])
                x, y = x[there], y[there]
                out += np.bincount(x, all_weights[x] * v[y], n)
            named = dict(zip(order, b.at, strict=True))
            yield slabs.rows_of(b, b.g[own], {k: named[k][own].astype(np.int32) for k in KEY} | {value: out[own]})

    return slabs.by_region(rows, keys, names, run, f"z int, y int, x int, `{value}` double")


def geometry_mismatch(tolerance: float = 1e-5, direction_tolerance: float = 1e-4) -> Column:
    """Names of the attributes in which structs ``left`` and ``right`` (shape, spacing, origin, direction) differ."""

    def differ(name: str, tol: float) -> Column:
        a, b = F.col(f"left.{name}"), F.col(f"right.{name}")
        close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tol), lambda same: same)
        return F.when((F.size(a) != F.size(b)) | ~close, F.lit(name))

    named = F.array(differ("shape", 0), differ("spacing", tolerance), differ("origin", tolerance), differ("direction", direction_tolerance))
    return F.filter(named, lambda n: n.isNotNull())
