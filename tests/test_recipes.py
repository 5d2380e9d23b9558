"""Recipes, commands and the operators that they stand on."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane import __main__ as command
from terrane.operators import images, models, prep, tables
from terrane.plans import recipes, workflows
from terrane.sources import volumes


def test_descriptions_are_checked(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": "x", "b": "y"}))
    assert recipes.check_config("dice", str(path)) == {"a": "x", "b": "y"}
    for bad in ({"a": "x"}, {"a": "x", "b": "y", "c": 1}):
        with pytest.raises(ValueError, match="keys"):
            recipes.check_config("dice", bad)
    with pytest.raises(ValueError, match="no recipe"):
        recipes.check_config("nothing", {})
    assert recipes.migrate({"out_dir": "o", "id_col": "i", "y": 1}) == {"output": "o", "id": "i", "y": 1}
    with pytest.raises(ValueError, match="twice"):
        recipes.migrate({"out_dir": "o", "output": "p"})
    assert set(recipes.example("dice")) == {"a", "b", "pattern", "output"}


def test_commands(spark, tmp_path, capsys):
    cells = spark.createDataFrame([(s, 0, y, x, 1 + (x > 1)) for s in (1, 2) for y in range(3) for x in range(4)], "subject long, z int, y int, x int, label int")
    volumes.write_maps(cells, str(tmp_path / "maps"))
    config = tmp_path / "c.yaml"
    config.write_text(f"maps: {tmp_path}/maps\nfeatures: [volume, msi, non_radiomics, ith_score]\n")
    command.main(["check", "extract", str(config)])
    command.main(["example", "icc"])
    (tmp_path / "old.json").write_text(json.dumps({"out_dir": "o"}))
    command.main(["migrate", str(tmp_path / "old.json"), str(tmp_path / "new.json")])
    assert json.loads((tmp_path / "new.json").read_text()) == {"output": "o"}
    command.main(["extract", str(config), "--output", str(tmp_path / "out")])
    got = {(r.subject, r.feature): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["1", "habitat_1_voxels"] == 6.0 and got["2", "habitat_2_num_regions"] == 1.0
    # four rows of two labels' faces, seen from both sides and once each
    assert got["1", "firstorder_1_and_2"] == 3.0 and got["1", "ith"] == 0.0
    assert "describes extract" in capsys.readouterr().out


def test_radiomics_of_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    grid = rng.integers(1, 9, (3, 4, 4)).astype(np.int16)
    mask = (rng.random((3, 4, 4)) < 0.7).astype(np.int16)
    for name, array in (("images", grid), ("masks", mask)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s1.nrrd").write_bytes(volumes.write_nrrd(array))
    r = recipes.run(spark, "radiomics", {"images": str(tmp_path / "images"), "masks": str(tmp_path / "masks"), "bin_width": 1.0}).first()
    own = grid[mask > 0].astype(float)
    assert r.subject == "s1" and r.firstorder_mean == pytest.approx(own.mean()) and r.firstorder_energy == pytest.approx((own**2).sum()) and r.glcm_contrast > 0


def test_models_by_recipe(spark, tmp_path):
    df = tables.synthetic_features(spark, 300, 4)
    path = str(tmp_path / "t.parquet")
    df.write.parquet(path)
    config = {"input": path, "id": "subject_id", "y": "label", "features": ["feature_000", "feature_001"], "model": next(iter(models.CLASSIFIERS))}
    trained = recipes.run(spark, "model", config | {"path": str(tmp_path / "m")}).collect()
    again = recipes.run(spark, "model", config | {"path": str(tmp_path / "m"), "mode": "predict"}).collect()
    assert sorted(map(str, trained)) == sorted(map(str, again)) and len(trained) == 300
    held = recipes.run(spark, "cv", config | {"folds": 3}).collect()
    assert len(held) == 300 and len({r.subject_id for r in held}) == 300


def test_synthetic_data_is_seeded(spark):
    a, b, c = (sorted(map(tuple, tables.synthetic_features(spark, 50, 3, "survival", s).collect())) for s in (1, 1, 2))
    assert a == b != c
    one = tables.synthetic_cohort(spark, 1, shape=(9, 9, 9), regions=3)
    means = [r.m for r in one.groupBy("region").agg(F.avg("T1").alias("m")).orderBy("region").collect()]
    assert len(means) == 3 and means == sorted(means)
    with pytest.raises(ValueError):
        tables.synthetic_features(spark, 5, 2, "other")


def test_neighbours_and_smote_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (60, 2)).astype(float)
    rows = [(i, 1, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(100 + i, 0, 0.0, 0.0) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    for block in (2048, 7):
        got = {}
        for r in models.neighbours(df.where("y = 1"), ["a", "b"], "id", 3, block).collect():
            got.setdefault(r.row, {})[r.rank] = (r.other, r.distance)
        for i in range(60):
            want = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in range(60) if j != i)[:3]
            assert [got[i][k] for k in (1, 2, 3)] == [(j, d) for d, j in want]
    made = models.smote(df, ["a", "b"], "y", "id", 3).collect()
    assert len(made) == 90 and {r.y for r in made} == {1}
    for r in made:
        near = [x[j] for _, j in sorted((float(((x[r.id] - x[j]) ** 2).sum()), j) for j in range(60) if j != r.id)[:3]]
        p = np.array([r.a, r.b])
        assert min(np.linalg.norm(p - x[r.id]) + np.linalg.norm(p - q) - np.linalg.norm(q - x[r.id]) for q in near) < 1e-9


def test_bins_by_centres(spark):
    x = np.concatenate([np.random.default_rng(1).normal(m, 0.1, 200) for m in (0, 10, 20)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    method = prep.binning(3, "kmeans")
    got = prep.apply(df.withColumn("raw", F.col("x")), prep.fit(df, ["x"], method), ["x"], method).collect()
    assert all(r.x == (None if r.raw is None else float(np.searchsorted([5.0, 15.0], r.raw))) for r in got)
    flat = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert {r.x for r in prep.apply(flat, prep.fit(flat, ["x"], method), ["x"], method).collect()} <= {0.0, 1.0, 2.0}


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (70, 2)).astype(float)
    a, b = (np.sign(x[:, None, k] - x[None, :, k]) for k in (0, 1))
    want = (a * b).sum() / np.sqrt(np.abs(a).sum() * np.abs(b).sum())
    df = spark.createDataFrame([(float(p), float(q)) for p, q in x] + [(None, 1.0)], "p double, q double")
    assert prep.kendall(df, "p", "q") == pytest.approx(want)
    assert prep.correlations(df, ["p", "q"], "kendall") == {("p", "q"): pytest.approx(want)}
    assert prep.kendall(df.withColumn("q", F.lit(1.0)), "p", "q") == 0.0


def test_linear_resampling_against_interpolation(spark):
    rng = np.random.default_rng(4)
    grid = rng.random((4, 3, 5))
    df = spark.createDataFrame([(1, z, y, x, float(v)) for (z, y, x), v in np.ndenumerate(grid)], "subject long, z int, y int, x int, value double")
    for target in (0.5, 0.7, 1.0, 1.6, 3.0):
        got = images.resample_linear(df, ["subject"], "value", (1.0, 1.0, 1.0), (target, 1.0, 1.0)).collect()
        places = np.arange(0, 3 + 1e-9, target)
        assert len(got) == len(places) * 15
        for r in got:
            assert r.value == pytest.approx(np.interp(places[r.z], np.arange(4), grid[:, r.y, r.x]))


def test_noise_level_and_equalisation(spark):
    rng = np.random.default_rng(2)
    grid = 50 + rng.normal(0, 3.0, (2, 40, 40))
    df = spark.createDataFrame([(1, z, y, x, float(v)) for (z, y, x), v in np.ndenumerate(grid)], "subject long, z int, y int, x int, value double")
    assert images.noise_sigma(df, ["subject"], "value") == pytest.approx(3.0, rel=0.1)
    assert images.noise_sigma(df.withColumn("value", F.lit(1.0)), ["subject"], "value") == 0.0
    # one tile and no clipping is plain equalisation: the share of cells at or below a bin
    got = {(r.z, r.y, r.x): r.value for r in images.equalise(df, ["subject"], "value", 40, 64, 1.0).collect()}
    level = np.minimum(np.floor((grid - grid.min()) / (grid.max() - grid.min()) * 64), 63)
    for z in (0, 1):
        assert all(got[z, y, x] == pytest.approx((level[z] <= level[z, y, x]).mean()) for y in range(0, 40, 7) for x in range(0, 40, 7))
    small = images.equalise(df, ["subject"], "value", 8, 64, 0.02).collect()
    assert len(small) == grid.size and all(0 <= r.value <= 1 + 1e-9 for r in small)
    assert {r.value for r in images.equalise(df.withColumn("value", F.lit(2.0)), ["subject"], "value").collect()} == {0.0}


def test_perturbations_and_precise_features(spark):
    rng = np.random.default_rng(6)
    grid = rng.normal(100, 20, (3, 6, 6))
    df = spark.createDataFrame([(1, z, y, x, float(v)) for (z, y, x), v in np.ndenumerate(grid)], "subject long, z int, y int, x int, value double")
    a, b, c = ({(r.z, r.y, r.x): r.value for r in recipes.perturb(df, ["subject"], "value", 1.0, s).collect()} for s in (1, 1, 2))
    assert a == pytest.approx(b) and a != pytest.approx(c) and len(a) == grid.size
    same = recipes.perturb_image(df, ["subject"], "value", "translate", shift=(0, 0, 0))
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        recipes.perturb_image(df, ["subject"], "value", "other")
    kept = {r.feature for r in recipes.precise_voxel_features(df, "subject", "value", radii=(1, 2), widths=(12.0, 14.0), base=(1, 12.0), sigma=0.01, threshold=-1.0).collect()}
    assert "firstorder_mean" in kept


def test_map_cohort_keeps_failures_apart(spark):
    def one(pdf):
        if pdf["subject"].iloc[0] == 2:
            raise RuntimeError("no")
        return pdf.assign(n=len(pdf)).head(1)

    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], "subject long, v double")
    got = {r.subject: (r.n, r.error) for r in recipes.map_cohort(df, "subject", one, "subject long, n long").collect()}
    assert got[1] == (2, None) and got[3] == (1, None) and got[2][0] is None and "no" in got[2][1]


def test_small_table_operators(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (2, "b", 1.0), (2, "a", 2.0), (None, "c", None)], "s long, m string, v double")
    one = tables.cohort_summary(df, "s", "m", "salt").first()
    assert (one.n_subjects, one.modalities) == (2, ["a", "b", "c"])
    assert one.digest == tables.cohort_summary(df.orderBy("v"), "s", "m", "salt").first().digest != tables.cohort_summary(df, "s", "m").first().digest
    with pytest.raises(ValueError):
        tables.whitelist(df, ["nothing"])
    ties = spark.createDataFrame([(k, float(k // 3)) for k in range(9)], "id long, v double")
    assert sorted((r["rank"], r.id) for r in tables.representatives(ties, "v", "id", 3).collect()) == [(0, 0), (4, 4), (8, 8)]
    assert [r.id for r in tables.representatives(ties, "v", "id", 1).collect()] == [4]
    assert tables.representatives(ties.limit(0), "v", "id", 3).count() == 0
    study = workflows.Study("raw(modality='v')", "s")
    assert sorted(r.f_v for r in recipes.subject_prefix(study, df.where("v is not null").select("s", "v")).collect()) == [1.0, 2.0, 3.0]
