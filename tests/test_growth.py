"""Steps that have to grow with their input: nothing passes the driver, no step is repeated, and results stay those of brute force."""

from __future__ import annotations

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane import catalog
from terrane.operators import graphs, images, models, regional, selection, slabs, spatial
from terrane.sources import volumes


def _maps(spark):
    rng = np.random.default_rng(3)
    rows = {("a b+c%20", *map(int, at)): int(v) for at, v in np.ndenumerate(rng.integers(0, 4, (3, 4, 5))) if v}
    rows |= {("2", 70, 1, 2): 3}
    return rows, spark.createDataFrame([(*k, v) for k, v in rows.items()], "subject string, z int, y int, x int, label int")


def test_tasks_write_label_maps(spark, tmp_path, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("a file passes the driver")

    rows, cells = _maps(spark)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    assert volumes.write_maps(cells, f"file:{tmp_path}/maps") == 2
    assert volumes.write_maps(cells, str(tmp_path / "maps")) == 2
    assert sorted(p.name for p in (tmp_path / "maps").iterdir()) == ["2_habitats.nrrd", "a b+c%20_habitats.nrrd"]
    assert {tuple(r)[:4]: r.label for r in volumes.map_cells(spark, str(tmp_path / "maps")).collect()} == rows


def test_label_maps_in_a_store_that_only_spark_opens(spark, tmp_path):
    rows, cells = _maps(spark)
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.growth.link./in", f"file://{tmp_path}")
    assert volumes.write_maps(cells, "viewfs://growth/in/maps") == 2
    assert {tuple(r)[:4]: r.label for r in volumes.map_cells(spark, "viewfs://growth/in/maps").collect()} == rows


def test_cells_leave_in_bounded_batches(spark, tmp_path, monkeypatch):
    rows, cells = _maps(spark)
    volumes.write_maps(cells, str(tmp_path))
    monkeypatch.setattr(volumes, "BATCH", 8)
    got = volumes.cells(spark, str(tmp_path), name=F.lit("n")).collect()
    assert len(got) == len(rows) and {r.subject for r in got} == {"n"}
    assert sorted((r.z, r.y, r.x, int(r.value)) for r in got) == sorted((*k[1:], v) for k, v in rows.items())


def _graph(rng):
    n = int(rng.integers(1, 40))
    return n, np.array([(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 4 / n], int).reshape(-1, 2)


def test_dense_graph_measures_equal_walks(monkeypatch):
    rng = np.random.default_rng(5)
    for _ in range(12):
        n, edges = _graph(rng)
        monkeypatch.setattr(graphs, "DENSE", 1024)
        dense = graphs.measures(n, edges) | graphs.extended(n, edges)
        share = graphs.clustering(n, edges)
        monkeypatch.setattr(graphs, "DENSE", 0)
        assert graphs.measures(n, edges) | graphs.extended(n, edges) == pytest.approx(dense, abs=1e-9)
        assert share == graphs.clustering(n, edges) == dense["clustering"]


def test_draws_at_once_are_those_in_turn():
    for seed, n in ((0, 1), (1, 2), (2, 97), (3, (1 << 31) - 2)):
        rng = np.random.default_rng(seed)
        turns = [(*rng.integers(n, size=2).tolist(), rng.random() < 0.5) for _ in range(50)]
        assert list(zip(*graphs._draws(seed, n, 50), strict=True)) == turns


def _batches(cells, size):
    """Record batches of (s, z, y, x, level) rows in the order of tasks."""
    table = pa.Table.from_pylist(sorted(cells, key=lambda r: (r["s"] is not None, r["s"] or "", r["z"])))
    return table.to_batches(max_chunksize=size)


def _whole(cells, rows, steps, keys=("s",)):
    """Every table's rows by region, and the most cells that a buffer held."""
    found, most = {name: {} for name in steps}, 0
    for b, tables in slabs.tables(iter(_batches(cells, 16)), list(keys), ["level"], steps):
        names = b.keys.column("s").to_pylist()
        for name, table in tables.items():
            for g, *row in zip(*(c.tolist() for c in table), strict=True):
                found[name][names[g], *map(int, row[: steps[name][1] - 1])] = row[steps[name][1] - 1 :]
    for b in slabs.stream(iter(_batches(cells, 16)), list(keys), ["level"], 1, rows):
        most = max(most, len(b.g))
    return found, most


def test_large_regions_go_slice_by_slice(monkeypatch):
    rng = np.random.default_rng(7)
    cells = [{"s": s, "z": int(z), "y": int(y), "x": int(x), "level": int(v)} for s, depth in (("a", 2), ("b", 40), ("c", 1), ("d", 25)) for (z, y, x), v in np.ndenumerate(rng.integers(0, 3, (depth, 3, 3))) if v and not (s == "d" and 9 < z < 13)]
    cells += [{**c, "level": 1} for c in ({"s": "e", "z": z, "y": 0, "x": 0} for z in range(50))]
    steps = {k: v for f in ("glcm", "glrlm", "glszm", "gldm", "ngtdm") for k, v in regional.steps([f], "level").items()}
    whole, _ = _whole(cells, None, steps)
    monkeypatch.setattr(slabs, "ROWS", 24)
    sliced, most = _whole(cells, 24, steps)
    assert most < 120  # of some 250 cells of a region
    assert any(k[0] == "e" and k[3] == 50 for k in whole["runs"])
    for name, table in whole.items():
        assert table.keys() == sliced[name].keys(), name
        for k, v in table.items():
            assert v == pytest.approx(sliced[name][k]), (name, k)


def test_regions_without_a_key_and_repeated_cells():
    cells = [{"s": s, "z": 0, "y": 0, "x": x, "level": 1} for s in (None, "a") for x in (0, 1, 1)]
    steps = regional.steps(["glcm", "gldm"], "level")
    found, _ = _whole([c for c in cells if c["s"]] + [c for c in cells if not c["s"]], None, steps)
    # as a join has it: two cells at x = 1 both lie beside the one at x = 0, and a missing key meets nothing
    assert {k[0]: v for k, v in found["pairs"].items()} == {"a": [4]}
    assert found["dependence"] == {(None, 1, 1): [3], ("a", 1, 3): [1], ("a", 1, 2): [2]}


def test_zones_from_one_exchange(spark):
    rng = np.random.default_rng(2)
    rows = [(s, int(z), int(y), int(x), int(v)) for s in (1, 2) for (z, y, x), v in np.ndenumerate(rng.integers(0, 3, (4, 4, 4)))]
    cells = spark.createDataFrame(rows, "subject long, z int, y int, x int, label int")
    slow = spatial.regions(spatial.components(cells, "subject"), "subject")
    fast = spatial.zone_regions(cells, "subject")
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    assert fast._jdf.queryExecution().executedPlan().toString().count("Join") == 0


def test_neighbours_of_more_rows_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(models, "KNN_TRAIN", 300)
    monkeypatch.setattr(models, "KNN_ROWS", 40)
    rng = np.random.default_rng(4)
    train = [(i, float(a), float(b), int(v)) for i, (a, b, v) in enumerate(zip(*rng.integers(0, 30, (2, 1500)) / 30, rng.integers(0, 2, 1500), strict=True))]
    asked = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 60, (100, 2)) / 60)] + [(0, 0.5, 0.5), (0, 0.5, 0.5)]
    t, q = spark.createDataFrame(train, "id long, a double, b double, y int"), spark.createDataFrame(asked, "id long, a double, b double")
    want = sorted((i, np.mean([r[3] for r in sorted(train, key=lambda r: ((r[1] - a) ** 2 + (r[2] - b) ** 2, r[0]))[:5]])) for i, a, b in asked)
    assert sorted(map(tuple, models.knn(t, q, ("a", "b"), "y", "id").collect())) == want


def test_ties_of_millions(spark):
    many = spark.range(6_500_000).select(F.lit(1.0).alias("v"), (F.col("id") % 2).cast("int").alias("y"))
    assert selection.mann_whitney(many, "v", "y")["z"] == 0.0


@pytest.mark.parametrize("name", ["paint_units", "survival_c_index"])
def test_means_at_an_edge(spark, name):
    """sf0.1 has means that are whole or lie beside a half, which other orders of summation put on the other side."""
    sf = "/root/testdata/sf0.1"
    assert oracle.differences(catalog.queries()[name](spark, sf), oracle.connection(sf), catalog.oracle_sql()[name]) == []


def test_quantiles_by_ranges_equal_the_aggregate(spark, monkeypatch):
    from terrane.operators import prep, running

    monkeypatch.setattr(running, "SINGLE", 10)
    df = spark.createDataFrame([(float(v),) for v in [*range(100), 5, 5, 7]] + [(None,), (float("nan"),)], "v double")
    shares = [(k + 0.5) / 37 for k in range(37)]
    want = df.agg(F.percentile(prep.finite(F.col("v")), F.array(*map(F.lit, shares)))).first()[0]
    assert prep.quantiles(df, "v", shares) == want
    assert prep.quantiles(df.where("v is null"), "v", shares) is None
    plan = prep.fit(df, ["v"], prep.binning(5, "kmeans"))._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and len(prep.fit(df, ["v"], prep.binning(5, "kmeans")).first()[0]["edges"]) == 4


@pytest.mark.parametrize("name", ["voxel_local_entropy", "graph_min_distance_edges", "graph_centroid_edges"])
def test_neighbours_are_not_exchanged(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_images_move_where_they_lie(spark, monkeypatch):
    """Slice by slice as in one buffer, about every axis, and without joins."""
    rng = np.random.default_rng(9)
    rows = [(s, int(z), int(y), int(x), float(rng.random())) for s in ("a", "b") for (z, y, x), v in np.ndenumerate(rng.integers(0, 4, (12, 4, 4))) if v]
    cells = spark.createDataFrame(rows, "s string, z int, y int, x int, v double")
    made = {
        "translate": lambda: images.translate(cells, ["s"], "v", (-1.5, 0.25, 1.0)), "resample": lambda: images.resample_linear(cells, ["s"], "v", (2.0, 1.0, 1.0), (1.0, 1.5, 1.0)),
        **{f"rigid {a}": lambda a=a: images.rigid(cells, ["s"], "v", 30.0, (1.25, 0.5, 0.0), a) for a in "zyx"},
    }
    whole = {k: {tuple(r)[:4]: r.v for r in f().collect()} for k, f in made.items()}
    monkeypatch.setattr(slabs, "ROWS", 40)
    for k, f in made.items():
        assert {tuple(r)[:4]: r.v for r in f().collect()} == pytest.approx(whole[k], abs=1e-12), k
        assert "Join" not in f()._jdf.queryExecution().executedPlan().toString()
    v = {r[:4]: r[4] for r in rows}
    for (s, z, y, x), got in whole["translate"].items():
        assert got == pytest.approx(sum(w * u * v.get((s, z + 1 + i, y - j, x - 1), 0.0) for i, w in ((0, 0.5), (1, 0.5)) for j, u in ((0, 0.75), (1, 0.25))))
