"""Survival trees, normality and the extended graph measures against brute force and known values."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import dist
from terrane.operators import graphs, selection, survival, survival_trees


def _outcomes(n: int, seed: int = 0) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x, z = rng.integers(0, 20, n), rng.random(n)
    time = np.ceil(20 * rng.exponential(np.exp(-0.2 * (x - 10))) + 1)
    return [(k, float(t), int(e), float(a), float(b)) for k, (t, e, a, b) in enumerate(zip(time, rng.random(n) < 0.8, x, z, strict=True))]


SCHEMA = "id long, time double, event int, x double, z double"


def _log_rank(rows, at):
    """|z| of the two-sample test, event time by event time."""
    diff = var = 0.0
    for t in sorted({r[1] for r in rows if r[2]}):
        risk = [r for r in rows if r[1] >= t]
        y, y1 = len(risk), sum(r[3] <= at for r in risk)
        d, d1 = sum(r[1] == t and r[2] for r in risk), sum(r[1] == t and r[2] and r[3] <= at for r in risk)
        diff += d1 - y1 * d / y
        var += (y1 / y) * (1 - y1 / y) * ((y - d) / (y - 1)) * d if y > 1 else 0.0
    return abs(diff) / var**0.5


def test_log_rank_gain_against_the_two_sample_test():
    rows = _outcomes(60)
    times = sorted({r[1] for r in rows if r[2]})
    values = sorted({r[3] for r in rows})
    n, d = np.zeros((len(values), len(times) + 1)), np.zeros((len(values), len(times) + 1))
    for _, t, e, x, _ in rows:
        at = values.index(x), np.searchsorted(times, t, side="right")
        n[at] += 1
        d[at] += e
    assert survival_trees.log_rank_gain(n[:, 1:], d[:, 1:]) == pytest.approx([_log_rank(rows, v) for v in values[:-1]])


def test_forest_splits_and_leaves(spark, monkeypatch):
    monkeypatch.setattr(survival_trees, "_drawn", lambda ids, tree, seed: np.ones(len(ids), int))
    rows = _outcomes(80)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = survival_trees.forest(df, ("x",), trees=1, depth=1, n_times=500)
    values = sorted({r[3] for r in rows})
    allowed = [v for v in values[:-1] if 3 <= sum(r[3] <= v for r in rows) <= len(rows) - 3]
    best = max(allowed, key=lambda v: _log_rank(rows, v))
    assert model.edges[0][model.cut[0, 0]] == best
    left = df.where(F.col("x") <= best)
    km = {r["time"]: r["survival"] for r in survival.kaplan_meier(left).collect()}
    got = dict(zip(model.times.tolist(), model.alive[0, 1].tolist(), strict=True))
    assert all(got[t] == pytest.approx(s) for t, s in km.items())


def test_forest_ranks_and_odd_tables(spark):
    rows = _outcomes(400)
    df = spark.createDataFrame(rows, SCHEMA)
    model = survival_trees.forest(df, ("x", "z"), trees=15, depth=3, seed=1)
    out = survival_trees.forest_predict(model, spark.createDataFrame(_outcomes(300, 9), SCHEMA), ("time", "event"), (2.0, 20.0, 60.0))
    assert survival.c_index(out).first().c_index > 0.7
    assert all(1 >= a >= b >= c >= 0 for (a, b, c) in (r.survival for r in out.collect()))
    again = survival_trees.forest(df.repartition(5), ("x", "z"), trees=15, depth=3, seed=1)
    assert (again.feature == model.feature).all() and (again.cut == model.cut).all()
    odd = spark.createDataFrame([(1, None, 1, 1.0, 1.0), (2, 3.0, 1, None, 2.0), (3, 4.0, 0, 1.0, None)], SCHEMA)
    small = survival_trees.forest(odd, ("x", "z"), trees=2, depth=2)
    assert survival_trees.forest_predict(small, odd, ("id",)).count() == 3
    none = survival_trees.forest(odd.limit(0), ("x", "z"), trees=2, depth=2)
    assert {r.risk for r in survival_trees.forest_predict(none, odd, ("id",), (1.0,)).collect()} == {0.0}


def test_boosting_lowers_the_partial_likelihood(spark):
    rows = _outcomes(200)
    df = spark.createDataFrame(rows, SCHEMA)
    model = survival_trees.boost(df, ("x", "z"), rounds=4, rate=0.5)
    out = survival_trees.boost_predict(model, df, ("id", "time", "event"), (5.0,)).collect()

    def loss(score):
        return -sum(score[r.id] - np.log(sum(np.exp(score[s.id]) for s in out if s.time >= r.time)) for r in out if r.event)

    assert loss({r.id: r.risk for r in out}) < loss({r.id: 0.0 for r in out}) - 10
    total = sum(1 / sum(np.exp(s.risk) for s in out if s.time >= r.time) for r in out if r.event and r.time <= 5)
    assert all(r.survival[0] == pytest.approx(np.exp(-total * np.exp(r.risk))) for r in out)


def test_shapiro_against_published_values():
    a = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
    b = [1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49]
    assert dist.shapiro(a) == pytest.approx((0.90047299861907959, 0.042089745402336121), rel=1e-5)
    assert dist.shapiro(b) == pytest.approx((0.9590270, 0.52460), rel=1e-4)
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    assert dist.shapiro(weights) == pytest.approx((0.78881, 0.006704), rel=1e-3)
    assert dist.shapiro([2.0] * 5) == (1.0, 1.0) and np.isnan(dist.shapiro([1.0])).all()


def test_statistical_test_chooses_by_normality(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 2, float(rng.normal(k % 2, 1)), float(rng.exponential(1 + k % 2) ** 2)) for k in range(200)]
    got = {r["feature"]: r for r in selection.statistical_test(spark.createDataFrame([*rows, (None, 1.0, 1.0), (0, None, None)], "y int, a double, b double"), ["a", "b"], "y")}
    assert got["a"]["test"] == "ttest" and got["b"]["test"] == "mannwhitney"
    zero, one = [r[2] for r in rows if r[0] == 0], [r[2] for r in rows if r[0] == 1]
    assert got["b"]["statistic"] == sum((x > y) + (x == y) / 2 for x, y in itertools.product(zero, one))


def _modularity(n, edges, groups):
    m = len(edges)
    degree = np.bincount(np.array(edges).ravel(), minlength=n)
    return sum(((sum(a in g and b in g for a, b in edges)) / m) - (sum(degree[v] for v in g) / (2 * m)) ** 2 for g in groups)


def test_communities():
    # two cliques of four and one of five, joined by single edges
    cliques = [range(0, 4), range(4, 8), range(8, 13)]
    edges = [e for c in cliques for e in itertools.combinations(c, 2)] + [(3, 4), (7, 8)]
    assert graphs.modularity(13, np.array(edges)) == pytest.approx(_modularity(13, edges, [set(c) for c in cliques]))
    assert graphs.modularity(3, np.zeros((0, 2), int)) == 0.0
    assert graphs.modularity(13, np.array(edges), np.full(len(edges), 2.5)) == pytest.approx(graphs.modularity(13, np.array(edges)))


def test_rich_club_and_small_world():
    ring = np.array([(k, (k + s) % 24) for k in range(24) for s in (1, 2)])
    swapped = graphs.swap_connected(24, ring, 1)
    assert sorted(np.bincount(swapped.ravel())) == [4] * 24 and len({tuple(sorted(e)) for e in swapped.tolist()}) == len(ring)
    assert graphs._connected(graphs._neighbours(24, swapped))
    assert graphs.small_world(24, ring) > 1.5 and graphs.small_world(5, ring[:4]) == 0.0
    star = graphs._neighbours(5, np.array([(0, 1), (0, 2), (0, 3), (1, 2)]))
    # degrees 3, 2, 2, 1 and 0: above 0 four nodes with four edges, above 1 three with three
    assert graphs.rich_club(star) == pytest.approx({0: 4 / 6, 1: 1.0})
    assert set(graphs.extended(24, ring)) == set(graphs.EXTENDED)
    assert not any(graphs.extended(2, np.zeros((0, 2), int)).values()) and not any(graphs.extended(0, np.zeros((0, 2), int)).values())
