"""All texture families of a region in one table, for any kind of region.

A region is whatever the ``by`` columns name: a subject's whole map, a label, a unit,
or the box around a voxel.  Levels are cut once over the subject, so regions of one
subject share them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regional, slabs, texture
from .spatial import KEY

FAMILIES = ("firstorder", "glcm", "glrlm", "glszm", "gldm", "ngtdm")


def _checked(families: Sequence[str]) -> list[str]:
    if unknown := [f for f in families if f not in FAMILIES]:
        raise ValueError(f"unknown family {unknown[0]}")
    return list(families)


def _schema(families: Sequence[str]) -> str:
    return ", ".join(f"{f}_{n} double" for f in families for n in regional.NAMES[f])


def features(cells: DataFrame, by: Sequence[str], value: str, bin_width: float, level_by: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """One row a region with the features of the families; cells are (level_by, by, z, y, x, value).

    Cells are exchanged once; every family is made where the region lies (see
    :mod:`.slabs`), with nulls for those that a region has none of (a lone cell has no
    neighbours).
    """
    keys, families = list(by), _checked(families)
    levels = texture.discretise(cells, level_by, value, bin_width).select(*keys, *KEY, "level", F.col(value).cast("double").alias("__x"))
    steps = regional.steps(families, "__x")

    def run(batches: Iterator) -> Iterator:
        for b, found in slabs.tables(batches, keys, ["level", "__x"], steps):
            yield slabs.rows_of(b, np.arange(b.n), regional.features(b.n, b.alone, found, families, bin_width))

    return slabs.by_region(levels, keys, ["level", "__x"], run, _schema(families))


#: Boxes around voxels that are made at once.
BOXES = 1 << 12


def voxel_features(cells: DataFrame, subject: str, value: str, bin_width: float, radius: int = 1, families: Sequence[str] = ("firstorder", "glcm")) -> DataFrame:
    """(subject, z, y, x, features) of the box around each cell.

    A cell's box is made where its subject lies, so cells are exchanged once and the work
    is a box's volume a cell.  Levels are counted from the box's smallest.
    """
    families = _checked(families)
    steps = regional.steps(families, "__x")
    most = BOXES
    reach = range(-radius, radius + 1)
    offsets = [(a, b, c) for a in reach for b in reach for c in reach]

    def run(batches: Iterator) -> Iterator:
        for whole in slabs.stream(batches, [subject], ["__x"], max(radius, 1)):
            raw = np.floor(whole.values["__x"] / bin_width)
            centres = np.flatnonzero(whole.own & ~whole.alone[whole.g])
            for start in range(0, len(centres), most):
                mine = centres[start : start + most]
                of = np.zeros(len(whole.g), bool)
                of[mine] = True
                number = np.full(len(whole.g), -1)
                number[mine] = np.arange(len(mine))
                pairs = [whole.pairs(o, of) for o in offsets]
                box, cell = number[np.concatenate([a for a, _ in pairs])], np.concatenate([b for _, b in pairs])
                low = np.full(len(mine), np.inf)
                np.fmin.at(low, box, raw[cell])
                level = raw[cell] - low[box] + 1
                level = np.where(np.isfinite(level), level, slabs.NONE).astype(np.int64)
                every = np.ones(len(box), bool)
                part = slabs.Buffer(box, [a[cell] for a in whole.at], {"level": level, "__x": whole.values["__x"][cell]}, None, len(mine), every, ~every, ~every, np.zeros(len(mine), bool))
                found = {name: step(part) for name, (step, _) in steps.items()}
                made = regional.features(len(mine), part.alone, found, families, bin_width)
                yield slabs.rows_of(whole, whole.g[mine], {k: a[mine].astype(np.int32) for k, a in zip(KEY, whole.at, strict=True)} | made)

    rows = cells.select(subject, *KEY, F.col(value).cast("double").alias("__x"))
    return slabs.by_region(rows, [subject], ["__x"], run, f"z int, y int, x int, {_schema(families)}")


def each_label(cells: DataFrame, subject: str, label: str, value: str, bin_width: float, labels: Sequence[int], families: Sequence[str] = FAMILIES) -> DataFrame:
    """One row a subject: ``habitat_<k>_<feature>`` of every label, null where it has no cell, and ``has_habitat_<k>``."""
    each = features(cells.where(F.col(label) != 0), [subject, label], value, bin_width, [subject], families)
    names = [c for c in each.columns if c not in (subject, label)]
    cols = []
    for k in labels:
        own = F.col(label) == k
        cols += [F.max(F.when(own, F.col(c))).alias(f"habitat_{k}_{c}") for c in names]
        cols.append(F.max(own.cast("int")).alias(f"has_habitat_{k}"))
    return each.groupBy(subject).agg(*cols)
