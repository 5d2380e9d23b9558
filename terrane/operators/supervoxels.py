"""Clustering within subjects: one task holds one subject's cells, whose number an image bounds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def lloyd(x: np.ndarray, k: int, seed: int = 0, max_iter: int = 300, n_init: int = 10) -> np.ndarray:
    """Labels from 0 of the best of several runs started by distance-weighted draws; never more clusters than rows."""
    k = min(k, len(x))
    rng = np.random.default_rng(seed)
    best, best_cost = np.zeros(len(x), int), np.inf
    for _ in range(n_init):
        centers = x[rng.integers(len(x))][None]
        while len(centers) < k:
            d = ((x[:, None] - centers[None]) ** 2).sum(2).min(1)
            centers = np.vstack([centers, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(max_iter):
            d = ((x[:, None] - centers[None]) ** 2).sum(2)
            labels = d.argmin(1)
            moved = np.array([x[labels == j].mean(0) if (labels == j).any() else centers[j] for j in range(k)])
            if np.allclose(moved, centers):
                break
            centers = moved
        cost = d[np.arange(len(x)), labels].sum()
        if cost < best_cost:
            best, best_cost = labels, cost
    return best


def mixture(x: np.ndarray, k: int, seed: int = 0, max_iter: int = 100, ridge: float = 1e-6) -> np.ndarray:
    """Labels from 0 of a full-covariance Gaussian mixture started from k-means."""
    labels = lloyd(x, k, seed, n_init=3)
    k, dims = int(labels.max()) + 1, x.shape[1]
    r = np.eye(k)[labels]
    for _ in range(max_iter):
        weight = r.sum(0) + 1e-12
        mean = (r.T @ x) / weight[:, None]
        logs = np.empty((len(x), k))
        for j in range(k):
            d = x - mean[j]
            cov = (r[:, j, None] * d).T @ d / weight[j] + ridge * np.eye(dims)
            inv = np.linalg.inv(cov)
            logs[:, j] = np.log(weight[j] / len(x)) - 0.5 * (np.einsum("ni,ij,nj->n", d, inv, d) + np.linalg.slogdet(cov)[1] + dims * np.log(2 * np.pi))
        top = logs.max(1, keepdims=True)
        new = np.exp(logs - top)
        new /= new.sum(1, keepdims=True)
        if np.abs(new - r).max() < 1e-6:
            break
        r = new
    return r.argmax(1)


def slic(x: np.ndarray, place: np.ndarray, k: int, compactness: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Labels from 0 of local clustering: centres start on an even grid and only take cells within twice its step."""
    k = min(k, len(x))
    step = max(1.0, (len(x) / k) ** (1 / 3))
    first = np.linspace(0, len(x) - 1, k).round().astype(int)
    order = np.lexsort(place.T[::-1])
    cx, cp = x[order[first]].astype(float), place[order[first]].astype(float)
    labels = np.zeros(len(x), int)
    for _ in range(rounds):
        near = ((place[:, None] - cp[None]) ** 2).sum(2)
        d = ((x[:, None] - cx[None]) ** 2).sum(2) + compactness**2 / step**2 * near
        d[near > (2 * step) ** 2 * 3] = np.inf
        lost = np.isinf(d).all(1)
        d[lost] = near[lost]
        labels = d.argmin(1)
        for j in range(k):
            if (own := labels == j).any():
                cx[j], cp[j] = x[own].mean(0), place[own].mean(0)
    return labels


def label(cells: DataFrame, subject: str, features: Sequence[str], method: str = "kmeans", k: int = 50, seed: int = 0, **options) -> DataFrame:
    """(subject, z, y, x, unit): units from 1 within each subject."""
    names = list(features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"], kind="stable")
        x = pdf[names].to_numpy(float)
        if method == "kmeans":
            found = lloyd(x, k, seed, **options)
        elif method == "gmm":
            found = mixture(x, k, seed, **options)
        elif method == "slic":
            found = slic(x, pdf[["z", "y", "x"]].to_numpy(float), k, **options)
        else:
            raise ValueError(f"unknown method {method}")
        _, unit = np.unique(found, return_inverse=True)
        return pdf[[subject, "z", "y", "x"]].assign(unit=unit.astype("int32") + 1)

    kind = cells.schema[subject].dataType.simpleString()
    return cells.select(subject, "z", "y", "x", *names).groupBy(subject).applyInPandas(run, f"{subject} {kind}, z int, y int, x int, unit int")


def drop_small(cells: DataFrame, subject: str, least: int = 30, connectivity: int = 1) -> DataFrame:
    """The labelled cells with components below the size given the label of the closest cell that stays; if none stays, all do."""
    offsets = [o for o in ((a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)) if 0 < sum(map(abs, o)) <= connectivity]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place = list(map(tuple, pdf[["z", "y", "x"]].to_numpy()))
        labels = dict(zip(place, pdf["label"].tolist(), strict=True))
        left, keep = set(labels), set()
        while left:
            start = left.pop()
            part, stack = [start], [start]
            while stack:
                c = stack.pop()
                for o in offsets:
                    n = (c[0] + o[0], c[1] + o[1], c[2] + o[2])
                    if n in left and labels[n] == labels[start]:
                        left.remove(n)
                        part.append(n)
                        stack.append(n)
            if len(part) >= least:
                keep.update(part)
        if keep and len(keep) < len(labels):
            stay = np.array(sorted(keep))
            for c in labels.keys() - keep:
                labels[c] = labels[tuple(stay[((stay - np.array(c)) ** 2).sum(1).argmin()])]
        return pdf.assign(label=[labels[c] for c in place])

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in (subject, "z", "y", "x", "label"))
    return cells.select(subject, "z", "y", "x", "label").where("label <> 0").groupBy(subject).applyInPandas(run, kinds)
