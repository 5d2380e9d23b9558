"""Clustering of pooled units and assignment to regions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dist import assign


def squared_distances(features: Sequence[str], centroids: Sequence[Sequence[float]]) -> Column:
    """Array of squared distances to each centroid; the centroids are constants of the plan."""
    return F.array(*(sum(((F.col(f) - float(v)) * (F.col(f) - float(v)) for f, v in zip(features, c, strict=True)), F.lit(0.0)) for c in centroids))


def nearest(df: DataFrame, features: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """The rows with ``habitat``: 1 + the place of the closest centroid, of equal ones the first; null if a feature is."""
    d = squared_distances(features, centroids)
    return df.withColumn("__d", d).withColumn("habitat", F.array_position("__d", F.array_min("__d")).cast("int")).drop("__d")


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__v", handleInvalid="skip").transform(df)


def fit_kmeans(df: DataFrame, features: Sequence[str], k: int, seed: int = 0, n_init: int = 3, max_iter: int = 100) -> np.ndarray:
    """Centroids of the best of several runs."""
    rows = _vectors(df, features).select("__v").persist()
    try:
        models = [KMeans(featuresCol="__v", k=k, seed=seed + i, maxIter=max_iter).fit(rows) for i in range(n_init)]
        best = min(models, key=lambda m: m.summary.trainingCost)
        return np.array(sorted(map(tuple, best.clusterCenters())))
    finally:
        rows.unpersist()


def fit_gmm(df: DataFrame, features: Sequence[str], k: int, seed: int = 0, max_iter: int = 100) -> GaussianMixture:
    return GaussianMixture(featuresCol="__v", k=k, seed=seed, maxIter=max_iter).fit(_vectors(df, features))


def inertia(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(within): summed squared distances to the label's mean, from sums of one aggregation."""
    cols = [c for f in features for c in (F.var_pop(f).alias(f"v_{f}"),)]
    by = df.groupBy(label).agg(F.count("*").alias("n"), *cols)
    return by.agg(F.sum(F.col("n") * sum((F.col(f"v_{f}") for f in features), F.lit(0.0))).alias("within"))


def gap(df: DataFrame, features: Sequence[str], label: str, row: str, n_references: int = 10, seed: int = 0) -> float:
    """Mean log dispersion of uniform references less the data's; references keep the data's labels.

    A reference value is a hash of the row, the feature and the replicate scaled to
    the feature's range, so it is the same on every attempt.
    """
    span = df.agg(*(c for f in features for c in (F.min(f).alias(f"a_{f}"), F.max(f).alias(f"b_{f}")))).first()
    logs = []
    for k in range(n_references):
        u = lambda f, k=k: F.pmod(F.xxhash64(F.col(row), F.lit(f), F.lit(seed * 1000 + k)), F.lit(1 << 40)) / float(1 << 40)
        ref = df.select(label, *((u(f) * (span[f"b_{f}"] - span[f"a_{f}"]) + span[f"a_{f}"]).alias(f) for f in features))
        logs.append(np.log(inertia(ref, features, label).first()[0]))
    return float(np.mean(logs) - np.log(inertia(df, features, label).first()[0]))


def calinski_harabasz(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(score): between-label by within-label dispersion."""
    v = [F.var_pop(f).alias(f"v_{f}") for f in features]
    total = df.agg(F.count("*").alias("t"), (F.count("*") * sum((F.var_pop(f) for f in features), F.lit(0.0))).alias("all")).first()
    by = df.groupBy(label).agg(F.count("*").alias("n"), *v).agg(F.count("*").alias("k"), F.sum(F.col("n") * sum((F.col(f"v_{f}") for f in features), F.lit(0.0))).alias("w"))
    k = F.col("k")
    return by.select((((F.lit(total["all"]) - F.col("w")) / (k - 1)) / (F.col("w") / (F.lit(total["t"]) - k))).alias("score"))


def align(overlap_counts: Sequence[tuple[int, int, int]]) -> dict[int, int]:
    """One-to-one map from the second map's labels to the first's with the most cells in common (label_a, label_b, n)."""
    a, b = sorted({x for x, _, _ in overlap_counts}), sorted({y for _, y, _ in overlap_counts})
    cost = np.zeros((len(a), len(b)))
    for x, y, n in overlap_counts:
        cost[a.index(x), b.index(y)] -= n
    return {b[j]: a[i] for i, j in assign(cost)}


def silhouette(df: DataFrame, features: Sequence[str], label: str, row: str, sample: int = 10_000) -> float:
    """Mean Euclidean silhouette of at most about ``sample`` rows, drawn evenly by a hash of the row id; 0 with one label.

    The sample is the feature: the measure compares all pairs of what it is given.
    """
    n = df.count()
    share = min(1.0, sample / max(n, 1))
    rows = df.where(F.pmod(F.xxhash64(row, F.lit(41)), F.lit(1 << 40)) < int(share * (1 << 40))).select(label, *features).collect()
    x = np.array([[float(r[f]) for f in features] for r in rows])
    _, at = np.unique([str(r[label]) for r in rows], return_inverse=True)
    k = int(at.max()) + 1 if len(at) else 0
    if k < 2:
        return 0.0
    size = np.bincount(at)
    total = 0.0
    for low in range(0, len(x), 256):
        d = np.sqrt(((x[low : low + 256, None] - x[None]) ** 2).sum(2))
        mean = np.stack([d[:, at == j].sum(1) for j in range(k)], 1)
        own = at[low : low + 256]
        i = np.arange(len(own))
        inside = mean[i, own] / np.maximum(size[own] - 1, 1)
        other = mean / size
        other[i, own] = np.inf
        outside = other.min(1)
        total += np.where(size[own] > 1, (outside - inside) / np.maximum(np.maximum(outside, inside), 1e-300), 0.0).sum()
    return float(total / len(x))
