"""Tree models of right-censored outcomes: a random survival forest and boosting on the Cox loss."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard, scratch
from .running import running

#: Poisson(1) probabilities summed up to 8: how often a row is drawn into a tree's sample.
_DRAWS = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])

#: Rows that quantiles are read from where a column has more distinct values than a tree tells apart.
SAMPLE = 16_384


@dataclass
class Forest:
    """Trees over features cut at ``edges``: node k has the children 2k + 1 and 2k + 2, and ``feature`` -1 marks a leaf."""

    features: tuple[str, ...]
    edges: list[np.ndarray]
    times: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    #: cumulative hazard and survival of every (tree, node) at ``times``
    hazard: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))
    alive: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 0)))


def _mix(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _drawn(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's sample: Poisson(1), fixed by the row's hash, the tree and the seed."""
    key = _mix(np.array([seed * 1_000_003 + tree + 1], np.uint64))
    u = (_mix(ids.view(np.uint64) ^ key) >> np.uint64(11)) / float(1 << 53)
    return np.searchsorted(_DRAWS, u, side="right")


def _walk(model: Forest, binned: np.ndarray, tree: int) -> np.ndarray:
    """The node where each row stands in a tree."""
    node = np.zeros(len(binned), int)
    while True:
        f = model.feature[tree, node]
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return node
        right = binned[inner, f[inner]] > model.cut[tree, node[inner]]
        node[inner] = 2 * node[inner] + 1 + right


def _binned(frame: pd.DataFrame, model: Forest) -> np.ndarray:
    """Each feature's number of edges below its value; nulls are in the first bin."""
    return np.stack([np.searchsorted(e, np.nan_to_num(frame[f].to_numpy(float), nan=-np.inf), side="left") for f, e in zip(model.features, model.edges, strict=True)], 1)


def _chosen(tree: int, node: int, n: int, most: int, seed: int) -> np.ndarray:
    """The features that a node may split on, drawn anew for each."""
    key = _mix(np.arange(n, dtype=np.uint64) + np.uint64((seed * 7919 + tree) * 65_537 + node + 1 << 10))
    return np.argsort(key)[:most]


def _quantiles(df: DataFrame, column: str, parts: int, low: int) -> np.ndarray:
    """All distinct values if at most ``parts``, else ``parts`` values at even ranks of the ``SAMPLE`` rows with the smallest hashes, from the least (``low`` 0) or up to the largest (1)."""
    few = [r[0] for r in df.select(F.col(column).cast("double")).where(f"{column} is not null").distinct().limit(parts + 1).collect()]
    if len(few) <= parts:
        return np.array(sorted(few))
    sample = [r[0] for r in df.where(f"{column} is not null").orderBy("__id", column).select(F.col(column).cast("double")).limit(SAMPLE).collect()]
    return np.unique(np.quantile(sample, [(k + low) / parts for k in range(parts)], method="inverted_cdf"))


def log_rank_gain(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """|z| of the log-rank test at every cut between bins, of rows and events counted by (bin, time)."""
    at_risk = np.cumsum(n[:, ::-1], 1)[:, ::-1].cumsum(0)
    events = d.cumsum(0)
    y, dd = at_risk[-1], events[-1]
    share = np.divide(at_risk, y, out=np.zeros_like(at_risk, float), where=y > 0)
    observed = (events - share * dd).sum(1)
    left = np.divide(y - dd, y - 1, out=np.zeros_like(y, float), where=y > 1)
    variance = (share * (1 - share) * left * dd).sum(1)
    return np.divide(np.abs(observed), np.sqrt(variance), out=np.zeros(len(n)), where=variance > 1e-12)[:-1]


def forest(df: DataFrame, features: Sequence[str], time: str = "time", event: str = "event", row: str = "id", trees: int = 100, depth: int = 5, min_split: int = 6, min_leaf: int = 3, max_features: int | None = None, bins: int = 32, n_times: int = 64, seed: int = 0) -> Forest:
    """A random survival forest: bootstrapped trees that split by the log-rank test, with hazards in their leaves.

    A level of all trees is one pass: every batch of rows walks the trees so far and counts
    rows and events by (tree, node, feature, bin, time), which are summed before and after
    the exchange.  A node's table, and the model on the driver, are bounded by ``bins``,
    ``n_times``, ``trees`` and ``depth``, not by the rows.  Feature values are told apart by
    ``bins`` quantiles and event times by ``n_times``, read from a bounded sample (the counts cover all rows); with fewer distinct values than these
    the splits are those of the exact test.  ``max_features`` is the square root by default.
    Rows without a time or event are left out; null features count as lowest; an empty table
    gives trees without events.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(event).isNotNull()).select(F.xxhash64(row).alias("__id"), F.col(time).cast("double").alias("__time"), F.col(event).cast("int").alias("__event"), *(F.col(f).cast("double").alias(f) for f in features))
    times = _quantiles(rows.where("__event = 1"), "__time", n_times, 0)
    edges = [_quantiles(rows, f, bins, 1)[:-1] for f in features]
    size, k = 2 ** (depth + 1) - 1, len(features)
    model = Forest(tuple(features), edges, times, np.full((trees, size), -1), np.zeros((trees, size), int))
    most = max_features or max(1, int(np.sqrt(k)))
    # a row is at risk at the event times up to its own; slot 0 is of rows that end before the first
    slots, width = len(times) + 1, max((len(e) for e in edges), default=0) + 1

    def counts(level: int, last: bool) -> DataFrame:
        first, beyond = 2**level - 1, 2 ** (level + 1) - 1
        chosen = {(t, v): _chosen(t, v, k, most, seed) for t in range(trees) for v in range(first, beyond)} if not last else {}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                binned = _binned(frame, model)
                slot = np.searchsorted(model.times, frame["__time"].to_numpy(float), side="right")
                dead, ids = frame["__event"].to_numpy(float), frame["__id"].to_numpy("int64")
                for t in range(trees):
                    w, node = _drawn(ids, t, seed), _walk(model, binned, t)
                    here = np.flatnonzero((w > 0) & ((node >= first) | last))
                    if not len(here):
                        continue
                    if last:
                        keys = [(node[here] * slots + slot[here], here, -1)]
                    else:
                        keys = []
                        for f in range(k):
                            may = here[np.array([f in chosen[t, v] for v in range(first, beyond)])[node[here] - first]]
                            keys.append(((node[may] * width + binned[may, f]) * slots + slot[may], may, f))
                    for key, at, f in keys:
                        cells, where = np.unique(key, return_inverse=True)
                        if len(cells):
                            yield pd.DataFrame({"tree": t, "feature": f, "cell": cells, "n": np.bincount(where, w[at]), "d": np.bincount(where, (w * dead)[at])})

        return rows.mapInPandas(run, "tree int, feature int, cell long, n double, d double").groupBy("tree", "feature", "cell").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        """The split of one tree's node: the largest log-rank statistic, ties to the first feature and cut."""
        found = (0.0, -1, 0)
        total = frame.loc[frame["feature"] == frame["feature"].min(), "n"].sum()
        if total >= min_split:
            for f, part in frame.groupby("feature"):
                n, d = np.zeros((width, slots)), np.zeros((width, slots))
                at = part["bin"].to_numpy(), part["slot"].to_numpy()
                n[at], d[at] = part["n"], part["d"]
                # leaving rows are at risk up to their slot; slot 0 is never at risk
                gain, left = log_rank_gain(n[:, 1:], d[:, 1:]), n.sum(1).cumsum()[:-1]
                gain[(left < min_leaf) | (total - left < min_leaf)] = 0.0
                if len(gain) and gain.max() > found[0] + 1e-12:
                    found = float(gain.max()), int(f), int(gain.argmax())
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "node": frame["node"].iloc[:1], "feature": found[1], "cut": found[2]})

    for level in range(depth if len(times) else 0):
        at = counts(level, False).withColumn("slot", F.col("cell") % slots).withColumn("bin", F.expr(f"(cell div {slots}) % {width}")).withColumn("node", F.expr(f"cell div {slots * width}"))
        splits = at.groupBy("tree", "node").applyInPandas(best, "tree int, node long, feature int, cut int").where("feature >= 0").collect()
        for s in splits:
            model.feature[s["tree"], s["node"]], model.cut[s["tree"], s["node"]] = s["feature"], s["cut"]
        if not splits:
            break
    n, d = np.zeros((trees, size, slots)), np.zeros((trees, size, slots))
    for r in counts(0, True).collect():
        n[r["tree"], r["cell"] // slots, r["cell"] % slots], d[r["tree"], r["cell"] // slots, r["cell"] % slots] = r["n"], r["d"]
    at_risk = np.cumsum(n[..., ::-1], -1)[..., ::-1][..., 1:]
    step = np.divide(d[..., 1:], at_risk, out=np.zeros_like(at_risk), where=at_risk > 0)
    model.hazard, model.alive = np.cumsum(step, -1), np.cumprod(1 - step, -1)
    return model


def forest_predict(model: Forest, df: DataFrame, keep: Sequence[str], times: Sequence[float] = ()) -> DataFrame:
    """Columns ``keep``, ``risk`` (expected events: the mean over trees of the cumulative hazard, summed over the event times) and ``survival``, an array with the mean over trees of the leaf's survival at each of ``times``."""
    held = df.sparkSession.sparkContext.broadcast(model)
    place = np.searchsorted(model.times, np.asarray(times, float), side="right") - 1
    kinds = {c: t for c, t in df.dtypes}
    inner = [f"__x{k}" for k in range(len(model.features))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for frame in frames:
            binned = _binned(frame[inner].set_axis(list(m.features), axis=1), m)
            risk, alive = np.zeros(len(frame)), np.zeros((len(frame), len(place)))
            for t in range(len(m.feature)):
                node = _walk(m, binned, t)
                risk += m.hazard[t, node].sum(1)
                alive += np.where(place >= 0, m.alive[t, node][:, np.maximum(place, 0)], 1.0) if m.alive.shape[2] else 1.0
            yield frame[list(keep)].assign(risk=risk / len(m.feature), survival=list(alive / len(m.feature)))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "risk double", "survival array<double>"])
    return df.select(*keep, *(F.col(f).cast("double").alias(x) for f, x in zip(model.features, inner, strict=True))).mapInPandas(run, schema)


@dataclass
class Boosted:
    """Regression trees whose values, times ``rate``, sum to the log hazard ratio, and its baseline (time, hazard)."""

    features: tuple[str, ...]
    rate: float
    trees: list[DecisionTreeRegressionModel]
    baseline: DataFrame


def _hazard(rows: DataFrame) -> DataFrame:
    """(t, hazard): the baseline's cumulative hazard at every distinct time, of rows (t, e, score)."""
    by = rows.groupBy("t").agg(F.sum("e").alias("d"), F.sum(F.exp("score")).alias("w"))
    risk = running(by, (), "t", {"r": "w"}, descending=True)
    return running(risk.select("t", (F.col("d") / F.col("r")).alias("step")), (), "t", {"hazard": "step"}).select("t", "hazard")


def boost(df: DataFrame, features: Sequence[str], time: str = "time", event: str = "event", row: str = "id", rounds: int = 100, rate: float = 0.1, depth: int = 3, subsample: float = 1.0, seed: int = 0) -> Boosted:
    """Gradient boosting on the Cox partial likelihood (Breslow ties).

    A round fits a tree to the gradient, a row's event less its expected events under the
    scores so far, and adds ``rate`` times it.  Scores are a written table, so a round's plan
    doesn't grow.  With ``subsample`` a tree sees rows drawn by hash of ``row``.  Rows with a
    null among time, event and features are left out.
    """
    rows = df.select(F.xxhash64(row).alias("h"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *(F.col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features))).dropna()
    rows = VectorAssembler(inputCols=[f"x{k}" for k in range(len(features))], outputCol="x").transform(rows).select("h", "t", "e", "x", F.lit(0.0).alias("score"))
    now = cut(rows)
    trees = []
    for k in range(rounds):
        with scratch(df.sparkSession):
            work = cut(now.join(_hazard(now), "t").withColumn("gradient", F.col("e") - F.exp("score") * F.col("hazard")))
            seen = work.where(F.pmod(F.xxhash64("h", F.lit(seed + k)), F.lit(1 << 20)) < int(subsample * (1 << 20))) if subsample < 1 else work
            tree = DecisionTreeRegressor(featuresCol="x", labelCol="gradient", predictionCol="step", maxDepth=depth, seed=seed + k).fit(seen)
        after = cut(tree.transform(now).select("h", "t", "e", "x", (F.col("score") + rate * F.col("step")).alias("score")))
        discard(now)
        now = after
        trees.append(tree)
    return Boosted(tuple(features), rate, trees, _hazard(now).select(F.col("t").alias("time"), "hazard"))


def boost_predict(model: Boosted, df: DataFrame, keep: Sequence[str], times: Sequence[float] = ()) -> DataFrame:
    """Columns ``keep``, ``risk`` (the log hazard ratio) and ``survival``, an array with the survival at each of ``times``.  Rows with a null feature are left out."""
    inner = [f"__x{k}" for k in range(len(model.features))]
    out = df.select(*keep, *(F.col(f).cast("double").alias(x) for f, x in zip(model.features, inner, strict=True)))
    out = VectorAssembler(inputCols=inner, outputCol="__x", handleInvalid="skip").transform(out)
    steps: list[Column] = []
    for k, tree in enumerate(model.trees):
        out = tree.copy().setFeaturesCol("__x").setPredictionCol(f"__step{k}").transform(out)
        steps.append(F.col(f"__step{k}"))
    out = out.select(*keep, (model.rate * sum(steps, F.lit(0.0))).alias("risk"))
    at = [0.0] * len(times)
    if times:
        upto = lambda t: F.when(F.col("time") <= t, F.col("hazard"))
        at = [v or 0.0 for v in model.baseline.agg(*(F.max(upto(float(t))) for t in times)).first()]
    return out.withColumn("survival", F.array(*(F.exp(-float(h) * F.exp("risk")) for h in at)).cast("array<double>"))
