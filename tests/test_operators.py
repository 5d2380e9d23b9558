"""Operators on small fixtures: hand-made cases and brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import dist
from terrane.functions.expr import compile_expression
from terrane.operators import cluster, metrics, models, prep, reliability, spatial, survival, tables, texture


def test_tails_against_known_values():
    assert dist.normal_ppf(0.975) == pytest.approx(1.959963984540054)
    assert dist.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert dist.f_ppf(0.95, 3, 10) == pytest.approx(3.7082648190468453)
    assert 2 * dist.t_sf(2.2281388519649385, 10) == pytest.approx(0.05)


def test_assignment_is_optimal():
    rng = np.random.default_rng(1)
    for n, m in ((3, 3), (4, 6), (5, 3)):
        cost = rng.random((n, m))
        best = min(sum(cost[r, c] for r, c in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[r, c] for c, r in zip(range(m), p)) for p in itertools.permutations(range(n), m))
        assert sum(cost[r, c] for r, c in dist.assign(cost)) == pytest.approx(best)


def test_knee_and_votes():
    assert dist.knee([10, 4, 2, 1.5, 1.2]) in (1, 2)
    assert dist.knee([3, 3, 3]) == 1
    assert dist.vote({"a": [1, 3, 2], "b": [9, 1, 5]}, {"a": "max", "b": "min"}) == 1
    assert dist.vote({"a": [1, 3, 2], "b": [1, 2, 5]}, {"a": "max", "b": "min"}) == 0


@pytest.mark.parametrize(("text", "value"), [("a % b", -7 - math.floor(-7 / 3) * 3), ("a // b", -3.0), ("-a ** 2", -49.0), ("clip(a, -5, 5) + sqrt(9)", -2.0), ("a / 0", None), ("minimum(a, b) * square(2)", -28.0)])
def test_expressions(spark, text, value):
    assert spark.createDataFrame([(-7.0, 3.0)], "a double, b double").select(compile_expression(text, ("a", "b"))).first()[0] == value


@pytest.mark.parametrize("text", ["c + 1", "__import__('os')", "a.b", "a if b else a", "abs(a, b)", "a +"])
def test_expressions_refuse(text):
    with pytest.raises(ValueError):
        compile_expression(text, ("a", "b"))


def _frame(spark, rows, schema="g string, x double"):
    return spark.createDataFrame(rows, schema)


def test_preprocessing_edges(spark):
    df = _frame(spark, [("a", 1.0), ("a", None), ("a", float("nan")), ("a", float("inf")), ("b", None)])
    m = prep.impute()
    got = sorted((r.g, r.x) for r in prep.apply(df, prep.fit(df, ["x"], m, ["g"]), ["x"], m, ["g"]).collect())
    assert got == [("a", 1.0)] * 4 + [("b", 0.0)]
    flat = _frame(spark, [("a", 2.0), ("a", 2.0)])
    for m in (prep.minmax(), prep.zscore(), prep.robust(), prep.binning(4)):
        assert {r.x for r in prep.apply(flat, prep.fit(flat, ["x"], m), ["x"], m).collect()} == {0.0}
    low = _frame(spark, [("a", -5.0)])
    m = prep.log_shift()
    assert prep.apply(low, prep.fit(flat, ["x"], m), ["x"], m).first().x is None
    empty = _frame(spark, [])
    assert prep.apply(empty, prep.fit(empty, ["x"], prep.zscore()), ["x"], prep.zscore()).count() == 0


def test_chain_checks_columns_and_replays(spark):
    df = _frame(spark, [("a", 1.0), ("a", 3.0)])
    chain = prep.Chain([("minmax", {})], ["x"]).fit(df)
    assert [r.x for r in chain.transform(_frame(spark, [("z", 5.0), ("z", None)])).collect()] == [2.0, 0.5]
    with pytest.raises(ValueError):
        chain.transform(df.drop("x"))
    with pytest.raises(ValueError):
        prep.Chain([("minmax", {})], ["x"]).transform(df)


def _cells(spark, grid):
    rows = [(1, int(z), int(y), int(x), int(v)) for (z, y, x), v in np.ndenumerate(grid) if v]
    return spark.createDataFrame(rows, "subject long, z int, y int, x int, label int")


def _zones(grid, offsets):
    """Brute-force sizes of connected cells of equal value: {value: sorted sizes}."""
    todo = {tuple(map(int, i)) for i in np.argwhere(grid)}
    out = {}
    while todo:
        start = todo.pop()
        stack, size, v = [start], 0, int(grid[start])
        while stack:
            c = stack.pop()
            size += 1
            for o in offsets:
                n = tuple(a + b for a, b in zip(c, o))
                if n in todo and grid[n] == v:
                    todo.remove(n)
                    stack.append(n)
        out.setdefault(v, []).append(size)
    return {k: sorted(v) for k, v in out.items()}


ALL = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]


def test_components_and_zones_against_brute_force(spark):
    grid = np.random.default_rng(3).integers(0, 3, (4, 5, 6))
    cells = _cells(spark, grid)
    reg = {r.label: (r.num_regions, r.largest) for r in spatial.regions(spatial.components(cells, "subject"), "subject").collect()}
    brute = _zones(grid, spatial.FACES)
    assert reg == {k: (len(v), max(v)) for k, v in brute.items()}
    zones = texture.glszm(cells.withColumnRenamed("label", "level"), ["subject"]).collect()
    found = {}
    for r in zones:
        found.setdefault(r.level, []).extend([r.size] * r.n)
    assert {k: sorted(v) for k, v in found.items()} == _zones(grid, ALL)


def test_long_chain_component(spark):
    """One component as long as a path can be: jumps must settle it."""
    grid = np.zeros((1, 1, 200), int)
    grid[:] = 1
    assert spatial.regions(spatial.components(_cells(spark, grid), "subject"), "subject").first().num_regions == 1


def test_interaction_counts_background(spark):
    grid = np.zeros((2, 2, 2), int)
    grid[0, 0, 0], grid[1, 1, 1] = 1, 2
    m = {(r.i, r.j): r.n for r in spatial.interaction(_cells(spark, grid), "subject").collect()}
    box = np.pad(grid, 1)
    brute = {}
    for axis in range(3):
        a, b = np.moveaxis(box, axis, 0)[:-1].ravel(), np.moveaxis(box, axis, 0)[1:].ravel()
        for i, j in [*zip(a.tolist(), b.tolist()), *zip(b.tolist(), a.tolist())]:
            brute[i, j] = brute.get((i, j), 0) + 1
    assert {k: v for k, v in m.items() if v} == brute


def test_empty_label_map(spark):
    cells = _cells(spark, np.zeros((1, 1, 1), int))
    assert spatial.components(cells, "subject").count() == 0
    assert spatial.interaction(cells, "subject").count() == 0


def test_auc_and_delong_against_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.random() < 0.4), float(rng.integers(0, 12)) / 12, float(rng.random())) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, y int, p double, q double")
    pos, neg = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    brute = sum((a[2] > b[2]) + 0.5 * (a[2] == b[2]) for a in pos for b in neg) / len(pos) / len(neg)
    assert metrics.auc(df, "y", "p").first().auc == pytest.approx(brute)
    r = {(r.score_a, r.score_b): r for r in metrics.delong(df, "y", ["p", "q"], "id").collect()}["p", "q"]
    assert r.auc_a == pytest.approx(brute) and 0 <= metrics.delong_test(r.asDict())[1] <= 1


def test_metrics_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, p double")
    assert metrics.auc(df, "y", "p").first().auc is None
    row = metrics.at_threshold(df, "y", "p", 0.6).first()
    assert (row.specificity, row.npv, row.sensitivity) == (0.0, 0.0, 0.5)
    with pytest.raises(ValueError):
        metrics.hosmer_lemeshow(df.withColumn("p", F.lit(0.5)), "y", "p")


def test_icc_limits_and_perfect_agreement(spark):
    rows = [(t, r, float(t * t)) for t in range(6) for r in range(3)]
    ms = reliability.mean_squares(spark.createDataFrame(rows, "t int, r int, v double"), "t", "r", "v").first().asDict()
    assert ms["ms_error"] == pytest.approx(0, abs=1e-9)
    noisy = {"n": 10, "k": 3, "ms_rows": 40.0, "ms_columns": 3.0, "ms_error": 2.0}
    for limits in (reliability.icc3_limits(noisy), reliability.icc2_limits(noisy)):
        assert 0 <= limits[0] < (40 - 2) / (40 + 2 * 2) < limits[1] <= 1


def test_tables_refuse_clashes(spark):
    a = spark.createDataFrame([(1, 2)], "id long, f long")
    with pytest.raises(ValueError):
        tables.join_one_to_one(a, a, ["id"])
    with pytest.raises(ValueError):
        tables.join_one_to_one(a.union(a), a.withColumnRenamed("f", "g"), ["id"])
    with pytest.raises(ValueError):
        tables.select_ids(a, spark.createDataFrame([(9,)], "id long"), "id")
    assert tables.merge({"a": a, "b": a}, ["id"]).columns == ["id", "f", "f__b"]


def test_smote_stays_between_neighbours(spark):
    rows = [(i, int(i % 5 == 0), float(i), float(i * 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    made = models.smote(df, ["a", "b"], "y", "id").collect()
    assert made and all(r.y == 1 and r.b == pytest.approx(2 * r.a) for r in made)


def test_cox_recovers_a_hazard_ratio(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, 1500)
    t = rng.exponential(1 / np.exp(0.8 * x))
    rows = [(float(round(a, 4)), int(a < 2), int(b)) for a, b in zip(np.minimum(t, 2), x)]
    fit = survival.cox(spark.createDataFrame(rows, "time double, event int, x int"), ["x"])
    assert abs(fit["coef"][0] - 0.8) < 4 * fit["se"][0] and fit["se"][0] < 0.1


def test_nearest_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(0.5,), (None,)], "a double")
    assert [r.habitat for r in cluster.nearest(df, ["a"], [(0.0,), (1.0,)]).collect()] == [1, None]


def test_label_alignment():
    assert cluster.align([(1, 2, 9), (1, 1, 1), (2, 1, 8), (2, 2, 2)]) == {1: 2, 2: 1}


def test_benjamini_hochberg_is_monotone(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5])], "i int, p double")
    q = [r.q for r in reliability.benjamini_hochberg(df, "p").orderBy("p").collect()]
    assert q == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_bootstrap_is_repeatable(spark):
    df = spark.range(200).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") * 7 % 50 / 50.0).alias("p"))
    a, b = (sorted(map(tuple, metrics.bootstrap_auc(df, "y", "p", "id", 10).collect())) for _ in range(2))
    assert a == b and len(a) == 10


def _graph_measures_brute(n, edges):
    """Distances by repeated squaring of reachability, clustering by triples."""
    a = np.zeros((n, n), int)
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    d = np.where(a, 1.0, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    clustering = []
    for v in range(n):
        own = np.flatnonzero(a[v])
        pairs = [(p, q) for p in own for q in own if p < q]
        clustering.append(np.mean([a[p, q] for p, q in pairs]) if pairs else 0.0)
    off = ~np.eye(n, dtype=bool)
    return np.mean(clustering), np.mean(np.where(np.isinf(d[off]), 0, 1 / d[off]))


def test_graph_measures_against_brute_force():
    from terrane.operators import graphs

    rng = np.random.default_rng(11)
    for n in (3, 7, 12):
        edges = np.array(sorted({tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(2 * n)}))
        got = graphs.measures(n, edges)
        clustering, efficiency = _graph_measures_brute(n, edges)
        assert got["clustering"] == pytest.approx(clustering) and got["global_efficiency"] == pytest.approx(efficiency)
        swapped = graphs.swap(edges, 1)
        assert np.bincount(swapped.ravel(), minlength=n).tolist() == np.bincount(edges.ravel(), minlength=n).tolist()
        assert len({tuple(e) for e in swapped.tolist()}) == len(edges)
    path = graphs.measures(3, np.array([[0, 1], [1, 2]]))
    assert path["betweenness_max"] == 1.0 and path["path_length"] == pytest.approx(4 / 3)
    assert graphs.measures(1, np.zeros((0, 2), int))["components"] == 1


def test_supervoxels_split_planted_groups(spark):
    from terrane.operators import supervoxels

    rows = [(s, 0, y, x, float(10 * (x >= 5)) + 0.01 * y) for s in (1, 2) for y in range(6) for x in range(10)]
    df = spark.createDataFrame(rows, "subject long, z int, y int, x int, f double")
    for method, k in (("kmeans", 2), ("gmm", 2), ("slic", 4)):
        got = supervoxels.label(df, "subject", ["f"], method, k).collect()
        assert len(got) == len(rows)
        if method != "slic":
            for s in (1, 2):
                assert len({(r.unit, r.x >= 5) for r in got if r.subject == s}) == 2
    few = supervoxels.label(df.where("y = 0 and x < 3 and subject = 1"), "subject", ["f"], "kmeans", 50).collect()
    assert len(few) == 3


def test_small_parts_join_the_closest(spark):
    from terrane.operators import supervoxels

    rows = [(1, 0, 0, x, 1) for x in range(6)] + [(1, 0, 0, 6, 2)] + [(1, 0, 0, x, 3) for x in range(7, 12)]
    df = spark.createDataFrame(rows, "subject long, z int, y int, x int, label int")
    got = {r.x: r.label for r in supervoxels.drop_small(df, "subject", 3).collect()}
    assert got[6] in (1, 3) and set(got.values()) == {1, 3}
    assert {r.label for r in supervoxels.drop_small(df, "subject", 99).collect()} == {1, 2, 3}


def test_logistic_slope_is_recovered(spark):
    from terrane.operators import selection

    rng = np.random.default_rng(4)
    x = rng.normal(size=3000)
    y = rng.random(3000) < 1 / (1 + np.exp(-(0.3 + 0.9 * x)))
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, rng.normal(size=3000), y)], "a double, b double, y int")
    fit = selection.logistic_wald(df, ["a", "b"], "y")
    assert abs(fit["a"]["coef"] - 0.9) < 4 * fit["a"]["se"] and fit["a"]["p"] < 1e-6 < fit["b"]["p"]
    assert selection.stepwise(df, ["a", "b"], "y", "forward")[0] == "a"
    assert "a" in selection.lasso(df.withColumn("y", F.col("y").cast("double")), ["a", "b"], "y", 3, 4)


def test_retest_mapping_finds_the_same_regions(spark):
    from terrane.operators import reliability as rel

    rows = [(h, float(h * 10 + k), float(5 - h), float(h * h)) for h in (1, 2, 3) for k in range(3)]
    df = spark.createDataFrame(rows, "habitat int, a double, b double, c double")
    assert {(r.test, r.retest) for r in rel.retest_mapping(df, df, "habitat", ["a", "b", "c"]).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_icc_file_selection(spark, tmp_path):
    import json

    from terrane.operators import selection

    path = tmp_path / "icc.json"
    path.write_text(json.dumps({"a": {"f": 0.9, "g": 0.8, "h": None}, "b": {"f": 0.76, "g": 0.1}}))
    assert selection.keep_by_icc_files(spark, str(path), ["a", "b"]) == ["f"]


def test_brier_without_censoring_is_plain(spark):
    df = spark.createDataFrame([(1, 1, [0.2, 0.1]), (5, 1, [0.9, 0.3])], "time int, event int, p array<double>")
    got = {r.t: r.brier for r in survival.brier_curve(df, "p", [2.0, 6.0]).collect()}
    assert got == {2.0: pytest.approx((0.04 + 0.01) / 2), 6.0: pytest.approx((0.01 + 0.09) / 2)}
    assert survival.integrated_brier(survival.brier_curve(df, "p", [2.0, 6.0])) == pytest.approx((0.025 + 0.05) / 2)
    assert {r.t: r.auc for r in survival.dynamic_auc(df.withColumn("risk", -F.col("time")), [2.0]).collect()} == {2.0: 1.0}


def _glcm_brute(grid):
    """Every feature from its definition: a dense symmetric table for each direction, normalised by itself, the features averaged."""
    e, top = 2.2e-16, int(grid.max())
    size = grid.shape
    out = []
    for o in [o for o in ALL if o > (0, 0, 0)]:
        t = np.zeros((top, top))
        for i in np.ndindex(size):
            j = tuple(a + b for a, b in zip(i, o))
            if all(0 <= a < n for a, n in zip(j, size)) and grid[i] and grid[j]:
                t[grid[i] - 1, grid[j] - 1] += 1
                t[grid[j] - 1, grid[i] - 1] += 1
        if not t.sum():
            continue
        p = t / t.sum()
        i, j = np.meshgrid(np.arange(1, top + 1), np.arange(1, top + 1), indexing="ij")
        px, py = p.sum(1), p.sum(0)
        ux, uy = (i * p).sum(), (j * p).sum()
        diff = np.array([p[np.abs(i - j) == k].sum() for k in range(top)])
        total = np.array([p[i + j == k].sum() for k in range(2, 2 * top + 1)])
        k, s = np.arange(top), np.arange(2, 2 * top + 1)
        h = lambda x: -(x * np.log2(x + e)).sum()
        sx = np.sqrt(((i - ux) ** 2 * p).sum())
        hxy1, hxy2 = -(p * np.log2(np.outer(px, py) + e)).sum(), h(np.outer(px, py))
        own = sorted({int(v) - 1 for v in grid.ravel() if v})
        q = np.array([[sum(p[a, c] * p[b, c] / (px[a] * py[c] + e) for c in own) for b in own] for a in own])
        values = np.sort(np.linalg.eigvals(q).real)
        out.append({
            "autocorrelation": (i * j * p).sum(), "joint_average": ux, "cluster_prominence": ((i + j - ux - uy) ** 4 * p).sum(), "cluster_shade": ((i + j - ux - uy) ** 3 * p).sum(), "cluster_tendency": ((i + j - ux - uy) ** 2 * p).sum(),
            "contrast": ((i - j) ** 2 * p).sum(), "correlation": ((i - ux) * (j - uy) * p).sum() / (sx * sx) if sx else 1.0, "difference_average": (k * diff).sum(), "difference_entropy": h(diff), "difference_variance": ((k - (k * diff).sum()) ** 2 * diff).sum(),
            "joint_energy": (p**2).sum(), "joint_entropy": h(p), "imc1": (h(p) - hxy1) / max(h(px), h(py)) if h(px) else 0.0, "imc2": math.sqrt(max(1 - math.exp(-2 * (hxy2 - h(p))), 0)), "idm": (diff / (1 + k**2)).sum(), "idmn": (diff / (1 + k**2 / top**2)).sum(),
            "id": (diff / (1 + k)).sum(), "idn": (diff / (1 + k / top)).sum(), "inverse_variance": (diff[1:] / k[1:] ** 2).sum(), "maximum_probability": p.max(), "sum_average": (s * total).sum(), "sum_entropy": h(total), "sum_squares": ((i - ux) ** 2 * p).sum(),
            "mcc": math.sqrt(max(values[-2], 0)) if len(values) > 1 else 1.0,
        })
    return {name: float(np.mean([x[name] for x in out])) for name in out[0]}


@pytest.mark.parametrize("shape", [(3, 4, 5), (1, 5, 6), (2, 2, 2)])
def test_co_occurrence_features_against_the_definition(spark, shape):
    """Directions apart, also where some have no pair (one slice) and where a level has no neighbour."""
    grid = np.random.default_rng(sum(shape)).integers(0, 6, shape)
    cells = _cells(spark, grid).withColumnRenamed("label", "level")
    matrix = texture.glcm(cells, ["subject"])
    got = texture.glcm_features(matrix, ["subject"], cells).join(texture.maximal_correlation(matrix, ["subject"]), "subject").first().asDict()
    want = _glcm_brute(grid)
    assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-9) and set(got) == set(want) | {"subject"}


@pytest.mark.parametrize("family", ["glrlm", "glszm", "gldm", "ngtdm", "firstorder", "glcm"])
def test_every_family_by_label_equals_the_label_alone(spark, family):
    from terrane.operators import radiomics

    grid = np.random.default_rng(17).integers(1, 5, (3, 4, 4))
    rows = [(1, z, y, x, float(v), int(1 + (x >= 2))) for (z, y, x), v in np.ndenumerate(grid)]
    df = spark.createDataFrame(rows, "subject long, z int, y int, x int, v double, label int")
    wide = radiomics.each_label(df, "subject", "label", "v", 1.0, (1, 2), (family,)).first().asDict()
    for k in (1, 2):
        alone = radiomics.features(df.where(f"label = {k}"), ["subject"], "v", 1.0, ["subject"], (family,)).first().asDict()
        own = {c.removeprefix(f"habitat_{k}_"): v for c, v in wide.items() if c.startswith(f"habitat_{k}_")}
        assert own == pytest.approx({c: v for c, v in alone.items() if c != "subject"})


def test_radiomics_by_label_and_voxel(spark):
    from terrane.operators import radiomics

    grid = np.random.default_rng(7).integers(1, 5, (3, 4, 4))
    rows = [(1, z, y, x, int(v), int(1 + (x >= 2))) for (z, y, x), v in np.ndenumerate(grid)]
    df = spark.createDataFrame(rows, "subject long, z int, y int, x int, v double, label int".replace("v double", "v long")).withColumn("v", F.col("v").cast("double"))
    wide = radiomics.each_label(df, "subject", "label", "v", 1.0, (1, 2, 9), ("firstorder", "glcm")).first()
    assert wide.has_habitat_1 == 1 and wide.has_habitat_9 == 0 and wide.habitat_9_glcm_contrast is None
    own = grid[:, :, :2]
    assert wide.habitat_1_firstorder_mean == pytest.approx(own.mean())
    assert wide.habitat_1_glcm_contrast == pytest.approx(_glcm_brute(own)["contrast"])
    voxel = {(r.z, r.y, r.x): r for r in radiomics.voxel_features(df, "subject", "v", 1.0, 1, ("firstorder",)).collect()}
    assert len(voxel) == grid.size and voxel[0, 0, 0].firstorder_mean == pytest.approx(grid[:2, :2, :2].mean())


def test_comparison_helpers(spark):
    from terrane.plans import comparison

    assert comparison.training_split(["test", "Train set", "val"]) == "Train set" and comparison.training_split(["a"]) is None
    df = spark.createDataFrame([(i, i % 2, (i % 2) * 0.5 + 0.01 * i, 0.5) for i in range(20)], "id long, y int, a double, b double")
    (row,) = comparison.pairwise(df, ["a", "b"], "y", "id")
    assert row["auc_a"] == 1.0 and row["auc_b"] == 0.5 and row["p"] < 1e-6
    best = comparison.closest_to_targets(df, "y", "a", {"sensitivity": 1.0, "specificity": 1.0}).first()
    assert best.distance == 0.0


def test_silhouette_against_pairs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 1, (20, 2)), rng.normal(4, 1, (15, 2))])
    lab = [0] * 20 + [1] * 15
    df = spark.createDataFrame([(i, int(l), float(a), float(b)) for i, (l, (a, b)) in enumerate(zip(lab, x))], "id long, l int, a double, b double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i, own in enumerate(lab):
        same = [j for j in range(35) if lab[j] == own and j != i]
        other = [j for j in range(35) if lab[j] != own]
        p, q = d[i, same].mean(), d[i, other].mean()
        s.append((q - p) / max(p, q))
    assert cluster.silhouette(df, ["a", "b"], "l", "id") == pytest.approx(np.mean(s))
    assert cluster.silhouette(df.where("l = 0"), ["a", "b"], "l", "id") == 0.0


def test_adaboost_beats_one_stump(spark):
    rows = [(i, int((i % 20 < 7) or (i % 20 >= 14)), float(i % 20)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, a double")
    got = models.adaboost(df, df, ["a"], "y", rounds=10).collect()
    assert np.mean([(r.prob >= 0.5) == (r.y == 1) for r in got]) > 0.95


def test_rigid_by_nothing_and_mcc_of_a_checkerboard(spark):
    from terrane.operators import images

    grid = np.indices((3, 4, 4)).sum(0) % 2 + 1
    cells = _cells(spark, grid).withColumn("v", F.col("label").cast("double"))
    same = {(r.z, r.y, r.x): r.v for r in images.rigid(cells, ["subject"], "v").collect()}
    assert same == {i: float(v) for i, v in np.ndenumerate(grid)}
    flat = texture.maximal_correlation(spark.createDataFrame([(1, 0, 1, 2, 10), (1, 0, 2, 1, 10)], "subject long, direction int, i int, j int, n long"), ["subject"]).first()
    assert flat.mcc == pytest.approx(1.0)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_by_ranges_equal_one_window(spark, descending):
    """Skewed values, nulls and groups, one of them a third of all rows."""
    from terrane.operators.running import running

    rng = np.random.default_rng(2)
    rows = [(None if k % 50 == 0 else int(k % 3 * (k % 7 > 3)), float(v), int(rng.integers(0, 5))) for k, v in enumerate(np.unique(np.round(rng.exponential(1, 3000) ** 3, 5)))]
    rows.append((1, None, 4))
    df = spark.createDataFrame(rows, "g int, v double, n int")
    for by in ((), ("g",)):
        one, many = (sorted(map(str, running(df, by, "v", {"upto": "n"}, descending, single).collect())) for single in (10_000, 10))
        assert one == many and len(one) == len(rows)


def test_no_task_of_all_rows(spark, monkeypatch):
    """Beyond the bound nothing is gathered in one partition but the ranges' totals."""
    from terrane.operators import running as module

    monkeypatch.setattr(module, "SINGLE", 100)
    df = spark.range(5000).select((F.col("id") % 2).cast("int").alias("y"), (F.xxhash64("id") % 100_000).cast("double").alias("p"))
    got = metrics.auc(df, "y", "p")
    rows = df.collect()
    pos, neg = np.array([r.p for r in rows if r.y]), np.array([r.p for r in rows if not r.y])
    assert got.first().auc == pytest.approx(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


@pytest.mark.parametrize("single", [200_000, 20])
def test_c_index_against_pairs(spark, monkeypatch, single):
    from terrane.operators import running as module

    monkeypatch.setattr(module, "SINGLE", single)
    rng = np.random.default_rng(6)
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, 30, 200), rng.integers(0, 2, 200), rng.integers(0, 40, 200) / 4)]
    pairs = [(a, b) for a in rows for b in rows if a[1] == 1 and (b[0] > a[0] or b[0] == a[0] and b[1] == 0)]
    r = survival.c_index(spark.createDataFrame(rows, "time int, event int, risk double")).first()
    assert (r.concordant, r.tied, r.comparable) == (sum(a[2] > b[2] for a, b in pairs), sum(a[2] == b[2] for a, b in pairs), len(pairs))
    assert survival.c_index(spark.createDataFrame([], "time int, event int, risk double")).first().c_index is None
