"""Files, specifications, studies and streams."""

from __future__ import annotations

import gzip
import json
import struct

import numpy as np
import pytest
from paths import TINY
from pyspark.sql import functions as F

from terrane.operators import images, prep
from terrane.plans import workflows
from terrane.plans.spec import Registry, Spec, parse_features
from terrane.sources import tables, volumes
from terrane.streaming import scoring

GRID = (np.arange(24).reshape(2, 3, 4) % 5).astype(np.int16)


def _nifti(array):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *array.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, 0.5, 1, 2, 1, 1, 1, 1)
    struct.pack_into("<f", head, 108, 352)
    return gzip.compress(bytes(head) + array.tobytes())


def _mha(array):
    return f"NDims = 3\nDimSize = {' '.join(map(str, array.shape[::-1]))}\nElementType = MET_SHORT\nElementSpacing = 0.5 1 2\nElementDataFile = LOCAL\n".encode() + array.tobytes()


def test_volume_formats(spark, tmp_path):
    for k, (name, data) in enumerate({"a_habitats.nrrd": volumes.write_nrrd(GRID, [2.0, 1.0, 0.5]), "b.nii.gz": _nifti(GRID), "c.mha": _mha(GRID)}.items()):
        array, spacing = volumes.decode(name, data)
        assert (array == GRID).all() and spacing == [2.0, 1.0, 0.5]
        (tmp_path / f"s {k}").mkdir()
        (tmp_path / f"s {k}" / name).write_bytes(data)
    got = volumes.cells(spark, str(tmp_path), "*.nii.gz").collect()
    assert {(r.z, r.y, r.x): r.value for r in got} == {i: float(v) for i, v in np.ndenumerate(GRID) if v}
    assert [r.subject for r in volumes.habitat_maps(spark, str(tmp_path)).collect()] == ["a"]
    (tmp_path / "bad.nrrd").write_bytes(b"no")
    with pytest.raises(Exception, match="bad.nrrd"):
        volumes.cells(spark, str(tmp_path)).collect()


def test_cohort_folder(spark, tmp_path):
    for kind, role in (("images", "T1"), ("masks", "tumor")):
        for subject in ("s1", "s2"):
            folder = tmp_path / kind / subject / role
            folder.mkdir(parents=True)
            for name in ("b.nrrd", "a.nrrd"):
                (folder / name).write_bytes(b"x")
    got = {(r.subject, r.kind, r.role): r.path.rsplit("/", 1)[1] for r in volumes.cohort(spark, str(tmp_path)).collect()}
    assert got == {(s, k, r): "a.nrrd" for s in ("s1", "s2") for k, r in (("images", "T1"), ("masks", "tumor"))}


def _dicom(*elements):
    return b"\0" * 128 + b"DICM" + b"".join(struct.pack("<HH2sH", g, e, v, len(x)) + x for g, e, v, x in elements)


def test_tags(spark, tmp_path):
    (tmp_path / "x.dcm").write_bytes(_dicom((0x0010, 0x0020, b"LO", b"P1 "), (0x0028, 0x0010, b"US", struct.pack("<H", 512))))
    (tmp_path / "y.dcm").write_bytes(b"nothing")
    got = {r.path[-5:]: r for r in volumes.tags(spark, str(tmp_path)).collect()}
    assert got["x.dcm"].tags == {"00100020": "P1", "00280010": "512"} and got["y.dcm"].tags is None and got["y.dcm"].error
    assert [r.path[-5:] for r in volumes.first_in_folder(spark, str(tmp_path)).collect()] == ["x.dcm"]


def test_feature_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,f,label\n01,1.5,0\n02,2.5,1\n")
    (tmp_path / "b.csv").write_text("id,f,label\n02,7,1\n03,8,1\n")
    sources = [{"path": str(tmp_path / f"{n}.csv"), "name": n, "features": ["f"]} for n in "ab"]
    got = {r.id: (r.a_f, r.b_f, r.label) for r in tables.read_feature_files(spark, sources, "id", "label").collect()}
    assert got == {"01": (1.5, None, 0), "02": (2.5, 7, 1), "03": (None, 8, 1)}
    with pytest.raises(ValueError):
        tables.read_feature_files(spark, [{**sources[0], "features": ["zz"]}], "id")
    assert tables.merge_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).columns == ["id", "f", "label", "f__b", "label__b"]


def test_units_and_families_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 2, 3.0)], "subject string, habitat int, f double")
    for fmt in ("parquet", "csv"):
        tables.write_units(df, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, tables.read_units(spark, str(tmp_path / fmt)).collect())) == [("a", 1, 2.0), ("b", 2, 3.0)]
    tables.write_families({"msi": df}, str(tmp_path / "out"))
    assert (tmp_path / "out" / "msi" / "habitat=1").exists()
    tables.write_manifest(spark, str(tmp_path / "run"), {"a": 1}, {"s": "ok"}, {})
    assert json.loads(spark.read.text(str(tmp_path / "run")).first()[0])["outcomes"] == {"s": "ok"}
    with pytest.raises(FileNotFoundError):
        tables.read_units(spark, str(tmp_path / "nowhere"))


def test_fingerprints():
    a, b = Spec("x", {"p": (1, 2), "q": np.float64(3)}), Spec("x", {"q": 3.0, "p": [1, 2]})
    assert a.fingerprint == b.fingerprint != Spec("x", {"p": [2, 1], "q": 3.0}).fingerprint
    assert Spec.from_dict(a.to_dict()).fingerprint == a.fingerprint
    with pytest.raises(ValueError):
        Spec.from_dict({"name": "x", "more": 1})


def test_feature_grammar():
    spec = parse_features('average(raw("T1", as_="a"), "T2", weights=[1, 3])')
    assert spec == Spec("average", {"weights": {"a": 1, "T2": 3}, "children": [{"name": "raw", "params": {"as_": "a", "modality": "T1"}}, {"name": "raw", "params": {"modality": "T2"}}]})
    assert parse_features('raw("T1", "T2")').params == {"modalities": ["T1", "T2"]}
    for bad in ("", "raw(T1)", "1 + 2", 'average(raw("a"), weights=[1, 2])', "raw(**x)"):
        with pytest.raises(ValueError):
            parse_features(bad)


def test_registry():
    r = Registry("thing")
    r.add("a")(lambda k=1: k)
    assert r.build(Spec("a", {"k": 5})) == 5 and r.load_plugins("terrane.none") == []
    with pytest.raises(ValueError):
        r.add("a")(lambda: 0)
    with pytest.raises(ValueError):
        r.build(Spec("b"))


EXPRESSION = 'concat(raw("l_quantity"), ratio(raw("l_extendedprice"), raw("l_quantity"), as_="unit_price"))'


def test_study_fits_saves_and_predicts(spark, tmp_path):
    df = spark.read.parquet(f"{TINY}/lineitem.parquet")
    study = workflows.two_step(EXPRESSION, "l_suppkey", ["l_partkey"], subject_steps=[("minmax", {})], cohort_steps=[("zscore", {})], n_habitats=3).fit(df)
    first = study.predict(df)
    assert first.select("l_suppkey", "l_partkey").distinct().count() == first.count() and {r.habitat for r in first.select("habitat").distinct().collect()} == {1, 2, 3}
    study.save(spark, str(tmp_path))
    again = workflows.Study.load(spark, str(tmp_path)).predict(df)
    assert first.select("l_suppkey", "l_partkey", "habitat").exceptAll(again.select("l_suppkey", "l_partkey", "habitat")).count() == 0
    with pytest.raises(ValueError):
        workflows.one_step(EXPRESSION, "l_suppkey").predict(df)


def test_run_from_a_description(spark, tmp_path):
    path = tmp_path / "run.json"
    path.write_text(json.dumps({"input": f"{TINY}/lineitem.parquet", "output": str(tmp_path / "out"), "study": {"features": EXPRESSION, "subject": "l_suppkey", "n_habitats": "auto", "most_habitats": 4}}))
    assert workflows.run_config(spark, str(path)).count() == spark.read.parquet(f"{TINY}/lineitem.parquet").count()
    assert tables.read_units(spark, str(tmp_path / "out")).count() > 0
    path.write_text(json.dumps({"input": "x", "sudy": {}}))
    with pytest.raises(ValueError):
        workflows.run_config(spark, str(path))


def test_stream_scores_like_a_batch(spark, tmp_path):
    df = spark.read.parquet(f"{TINY}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    chain = prep.Chain([("minmax", {})], ["value"]).fit(df)
    centres = [(0.1,), (0.5,), (0.9,)]
    for _ in range(2):  # the second run finds nothing new
        stream = scoring.read_units(spark, str(tmp_path / "in"), "event_id long, ts timestamp, value double")
        scoring.write(scoring.score(stream, chain, ["value"], centres), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    batch = scoring.score(df, chain, ["value"], centres)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == df.count() and batch.select("event_id", "habitat").exceptAll(got.select("event_id", "habitat")).count() == 0
    assert scoring.sizes(batch, "ts").agg(F.sum("n")).first()[0] == df.count()


def test_geometry_and_growth(spark):
    g = "struct<shape:array<double>,spacing:array<double>,origin:array<double>,direction:array<double>>"
    one, two = ([2.0], [1.0], [0.0], [1.0]), ([2.0], [1.1], [0.0], [1.00005])
    assert spark.createDataFrame([(one, two)], f"left {g}, right {g}").select(images.geometry_mismatch().alias("m")).first().m == ["spacing"]
    cells = spark.createDataFrame([(1, 0, 0, 0, 1), (1, 0, 0, 4, 2)], "subject long, z int, y int, x int, label int")
    grown = {(r.z, r.y, r.x): r.label for r in images.dilate(cells, ["subject"], 2).collect()}
    assert len(grown) == 2 * 25 - 1 and grown[0, 0, 2] == 1 and grown[0, 0, 3] == 2
    assert {(r.x, r.label) for r in images.erode(images.dilate(cells.where("label = 1"), ["subject"], 1), ["subject"], 1).collect()} == {(0, 1)}
