"""Files, recipes and the smaller table operators: written to the shared folder, read back, and compared with the tables they came from."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import images, prep, tables
from ..plans import recipes
from ..sources import tables as files
from ..sources import volumes
from ..storage import shared_dir
from .inputs import CELLS, PREDICTIONS, SESSIONS, cells, predictions, rounded, sessions, table, units

_WORKS = f"WITH {CELLS}"


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _maps(spark, sf_dir) -> str:
    folder = _folder(spark)
    volumes.write_maps(cells(spark, sf_dir), folder)
    return folder


@register("volume_maps_round_trip", f"{_WORKS} SELECT CAST(subject AS VARCHAR) AS subject, z, y, x, label FROM cells")
def volume_maps_round_trip(spark, sf_dir):
    """Label maps written as compressed volumes, found by their suffix and decoded."""
    return volumes.map_cells(spark, _maps(spark, sf_dir))


@register("volume_file_listing", f"{_WORKS} SELECT subject || '_habitats.nrrd' AS name FROM cells GROUP BY subject")
def volume_file_listing(spark, sf_dir):
    return volumes.files(spark, _maps(spark, sf_dir), "*.nrrd").select("name")


@register("volume_first_in_folder", f"{_WORKS} SELECT min(CAST(subject AS VARCHAR) || '_habitats.nrrd') AS name FROM cells")
def volume_first_in_folder(spark, sf_dir):
    return volumes.first_in_folder(spark, _maps(spark, sf_dir), "*.nrrd").select(F.element_at(F.split("path", "/"), -1).alias("name"))


@register("cohort_folder_scan", f"{_WORKS} SELECT CAST(subject AS VARCHAR) AS subject, 'masks' AS kind, 'tumor' AS role, 'a_habitats.nrrd' AS name FROM cells WHERE z = 1 GROUP BY subject")
def cohort_folder_scan(spark, sf_dir):
    """A cohort folder of masks by subject and role, of which the first file by name counts."""
    root = _folder(spark)
    one = cells(spark, sf_dir).where("z = 1")
    both = one.withColumn("name", F.explode(F.array(F.lit("a"), F.lit("b"))))
    volumes.write_maps(both.withColumn("subject", F.concat(F.lit("masks/"), F.col("subject"), F.lit("/tumor/"), F.col("name"))), root)
    return volumes.cohort(spark, root).select("subject", "kind", "role", F.element_at(F.split("path", "/"), -1).alias("name"))


@register("units_table_round_trip", "SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def units_table_round_trip(spark, sf_dir):
    folder = _folder(spark)
    files.write_units(units(spark, sf_dir), folder)
    return files.read_units(spark, folder)


@register("units_table_csv", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def units_table_csv(spark, sf_dir):
    folder = _folder(spark)
    files.write_units(units(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), folder, "csv")
    found = files.read_units(spark, folder)
    return found.select(F.col("l_orderkey").cast("long"), F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("double"), F.col("l_tax").cast("double"))


@register("feature_families_by_habitat", f"{_WORKS} SELECT label AS habitat, count(*) AS n FROM cells GROUP BY 1")
def feature_families_by_habitat(spark, sf_dir):
    """A family written in parts by habitat, counted from the files."""
    folder = _folder(spark)
    files.write_families({"cells": cells(spark, sf_dir).withColumnRenamed("label", "habitat").select("subject", "habitat")}, folder)
    return spark.read.option("header", "true").csv(f"{folder}/cells").groupBy(F.col("habitat").cast("int").alias("habitat")).agg(F.count("*").alias("n"))


@register("run_manifest", "SELECT 'lineitem' AS input, count(*) AS n, '1' AS version FROM lineitem")
def run_manifest(spark, sf_dir):
    folder = _folder(spark)
    n = table(spark, sf_dir, "lineitem").count()
    files.write_manifest(spark, folder, {"input": "lineitem", "rows": n}, {"all": "done"}, {"terrane": "1"})
    got = json.loads(spark.read.text(folder).first()[0])
    return spark.createDataFrame([(got["spec"]["input"], got["spec"]["rows"], got["versions"]["terrane"])], "input string, n long, version string")


@register("acquisition_times", "SELECT CAST(o_orderkey AS VARCHAR) AS subject, phase, 3600 * (o_orderkey % 24) + 60 * (o_orderkey % 60) + k AS seconds FROM orders, (VALUES ('plain', 1), ('portal', 2)) t(phase, k)")
def acquisition_times(spark, sf_dir):
    """A table with one column of times a phase, in long form."""
    folder = _folder(spark)
    o = F.col("o_orderkey")
    at = lambda k: F.format_string("%02d-%02d-%02d", (o % 24).cast("int"), (o % 60).cast("int"), F.lit(k))
    table(spark, sf_dir, "orders").select(o.alias("Name"), at(1).alias("plain"), at(2).alias("portal")).write.option("header", "true").csv(folder)
    found = files.read_times(spark, folder)
    return found.select("subject", "phase", (F.hour("time") * 3600 + F.minute("time") * 60 + F.second("time")).cast("long").alias("seconds"))


@register("recipe_extract_volume", f"{_WORKS}, n AS (SELECT subject, label, count(*) AS v, sum(count(*)) OVER (PARTITION BY subject) AS t FROM cells GROUP BY subject, label), g AS (SELECT s.subject, l.label, coalesce(v, 0) AS v, coalesce(v / t, 0.0) AS f FROM (SELECT DISTINCT subject FROM cells) s CROSS JOIN (VALUES (1), (2), (3)) l(label) LEFT JOIN n ON n.subject = s.subject AND n.label = l.label) SELECT CAST(subject AS VARCHAR) AS subject, 'volume' AS family, 'habitat_' || label || '_' || k AS feature, round(CASE WHEN k = 'voxels' THEN CAST(v AS DOUBLE) ELSE f END, 6) AS value FROM g, (VALUES ('voxels'), ('fraction')) x(k)")
def recipe_extract_volume(spark, sf_dir):
    return rounded(recipes.run(spark, "extract", {"maps": _maps(spark, sf_dir), "features": ["volume"], "labels": [1, 2, 3]}))


@register("recipe_dice", f"{_WORKS} SELECT CAST(subject AS VARCHAR) AS subject, label, 1.0::DOUBLE AS dice FROM cells GROUP BY ALL")
def recipe_dice(spark, sf_dir):
    folder = _maps(spark, sf_dir)
    return recipes.run(spark, "dice", {"a": folder, "b": folder})


@register("recipe_view", f"{_WORKS} SELECT CAST(subject AS VARCHAR) AS subject, label, count(*) AS voxels, min(z) AS low, max(z) AS high FROM cells GROUP BY ALL")
def recipe_view(spark, sf_dir):
    return recipes.run(spark, "view", {"map": _maps(spark, sf_dir)}).select("subject", "label", "voxels", "extent_z.low", "extent_z.high")


@register("recipe_icc", f"WITH {SESSIONS}, m AS (SELECT subject, session, value FROM sessions), n AS (SELECT count(DISTINCT subject) AS n, count(DISTINCT session) AS k, avg(value) AS g FROM m), r AS (SELECT sum((a - g) ** 2) * any_value(k) / (any_value(n) - 1) AS msr FROM (SELECT avg(value) AS a FROM m GROUP BY subject), n), c AS (SELECT sum((a - g) ** 2) * any_value(n) AS ssc FROM (SELECT avg(value) AS a FROM m GROUP BY session), n), t AS (SELECT sum((value - g) ** 2) AS sst FROM m, n), e AS (SELECT n, k, msr, (sst - msr * (n - 1) - ssc) / ((n - 1) * (k - 1)) AS mse, ssc / (k - 1) AS msc FROM n, r, c, t) SELECT 'value' AS feature, n, k, round((msr - mse) / (msr + (k - 1) * mse), 5) AS icc3, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 5) AS icc2 FROM e")
def recipe_icc(spark, sf_dir):
    """Three files of one feature, one a session."""
    root, paths = _folder(spark), []
    for k in (1, 2, 3):
        paths.append(f"{root}/{k}.parquet")
        sessions(spark, sf_dir).where(F.col("session") == k).select("subject", "value").write.parquet(paths[-1])
    found = recipes.run(spark, "icc", {"files": paths, "id": "subject"})
    return rounded(found.select("feature", "n", "k", "icc3", "icc2"), 5)


@register("recipe_compare", f"WITH {PREDICTIONS}, l AS (SELECT split, y, 'p' AS model, p FROM predictions UNION ALL SELECT split, y, 'p2', p2 FROM predictions) SELECT split, model, round((count(*) FILTER (y = 1 AND p >= 0.5) + count(*) FILTER (y <> 1 AND p < 0.5)) / count(*), 6) AS accuracy FROM l GROUP BY ALL")
def recipe_compare(spark, sf_dir):
    path = f"{_folder(spark)}/p.parquet"
    predictions(spark, sf_dir).write.parquet(path)
    return rounded(recipes.run(spark, "compare", {"predictions": path, "id": "id", "y": "y", "models": ["p", "p2"]}).select("split", "model", "accuracy"))


@register("recipe_merge", "SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1")
def recipe_merge(spark, sf_dir):
    root = _folder(spark)
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
    by.agg(F.sum("l_quantity").alias("q")).write.option("header", "true").csv(f"{root}/a.csv")
    by.agg(F.count("*").alias("n")).write.option("header", "true").csv(f"{root}/b.csv")
    found = recipes.run(spark, "merge", {"files": [f"{root}/a.csv", f"{root}/b.csv"]})
    return found.select(F.col("l_orderkey").cast("long"), F.col("q").cast("double"), F.col("n").cast("long"))


@register("recipe_preprocess", f"{_WORKS}, s AS (SELECT subject, avg(label) AS m, stddev_pop(label) AS d FROM cells GROUP BY 1) SELECT CAST(subject AS VARCHAR) AS subject, z, y, x, round((label - m) / CASE WHEN d < 1e-8::DOUBLE THEN 1.0 ELSE d END, 5) AS value FROM cells JOIN s USING (subject)")
def recipe_preprocess(spark, sf_dir):
    return rounded(recipes.run(spark, "preprocess", {"images": _maps(spark, sf_dir), "steps": ["zscore"]}), 5)


@register("cohort_summary", "SELECT count(DISTINCT l_suppkey) AS n_subjects, list_sort(list(DISTINCT l_returnflag)) AS modalities FROM lineitem")
def cohort_summary(spark, sf_dir):
    return tables.cohort_summary(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag").select("n_subjects", "modalities")


@register("feature_whitelist", "SELECT l_orderkey, l_linenumber, l_tax, l_quantity FROM lineitem")
def feature_whitelist(spark, sf_dir):
    return tables.whitelist(units(spark, sf_dir), ["l_tax", "l_quantity"], ["l_orderkey", "l_linenumber"])


@register("representative_samples", "WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank, count(*) OVER () AS n FROM orders) SELECT o_orderkey, o_totalprice, rank FROM r WHERE rank IN (0, CAST(round_even((n - 1) / 4.0::DOUBLE, 0) AS BIGINT), CAST(round_even((n - 1) / 2.0::DOUBLE, 0) AS BIGINT), CAST(round_even(3 * (n - 1) / 4.0::DOUBLE, 0) AS BIGINT), n - 1)")
def representative_samples(spark, sf_dir):
    """A report of five orders over the range of prices."""
    return tables.representatives(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 5).select("o_orderkey", "o_totalprice", F.col("rank").cast("long").alias("rank"))


@register("voxel_frame", f'{_WORKS} SELECT subject, z, y, x, price AS "a-T1", CASE WHEN z > 2 THEN tax END AS "b-T1" FROM cells WHERE label = 1')
def voxel_frame(spark, sf_dir):
    c = cells(spark, sf_dir)
    keys = ("subject", "z", "y", "x")
    return tables.voxel_frame({"a": c.select(*keys, F.col("price").alias("value")), "b": c.where("z > 2").select(*keys, F.col("tax").alias("value"))}, c, keys, 1, "T1")


@register("prep_binning_kmeans_cohort")
def prep_binning_kmeans_cohort(spark, sf_dir):
    rows = units(spark, sf_dir)
    method = prep.binning(5, "kmeans")
    return prep.apply(rows, prep.fit(rows, ["l_extendedprice"], method), ["l_extendedprice"], method).groupBy(F.col("l_extendedprice").alias("bin")).agg(F.count("*").alias("n"))


@register("prep_kendall", "WITH p AS (SELECT p_size AS a, p_retailprice AS b FROM part) SELECT round(sum(sign(s.a - t.a) * sign(s.b - t.b)) / sqrt(sum(abs(sign(s.a - t.a))) * sum(abs(sign(s.b - t.b)))), 9) AS tau FROM p s, p t")
def prep_kendall(spark, sf_dir):
    return spark.createDataFrame([(round(prep.kendall(table(spark, sf_dir, "part"), "p_size", "p_retailprice"), 9),)], "tau double")


@register("image_resample_linear", f"{_WORKS}, b AS (SELECT subject, max(z) AS mz FROM cells GROUP BY 1), g AS (SELECT c.subject, c.y, c.x, t.k AS z, c.tax * (1 - abs(t.k * 0.5::DOUBLE - c.z)) AS v FROM cells c JOIN b USING (subject) JOIN (SELECT unnest(range(0, 40)) AS k) t ON abs(t.k * 0.5::DOUBLE - c.z) < 1 AND t.k * 0.5::DOUBLE <= mz) SELECT subject, CAST(z AS INTEGER) AS z, y, x, round(sum(v), 6) AS tax FROM g GROUP BY ALL")
def image_resample_linear(spark, sf_dir):
    """Slices of half the distance."""
    return rounded(images.resample_linear(cells(spark, sf_dir), ["subject"], "tax", (2.0, 1.0, 1.0), (1.0, 1.0, 1.0)))


@register("image_equalise")
def image_equalise(spark, sf_dir):
    return rounded(images.equalise(cells(spark, sf_dir), ["subject"], "tax", 6, 32))


@register("image_perturbation_chain")
def image_perturbation_chain(spark, sf_dir):
    return rounded(recipes.perturb(cells(spark, sf_dir), ["subject"], "tax", 0.01))


@register("synthetic_table")
def synthetic_table(spark, sf_dir):
    return tables.synthetic_features(spark, 200, 5, "survival")


@register("synthetic_cohort")
def synthetic_cohort(spark, sf_dir):
    return tables.synthetic_cohort(spark, 2, shape=(8, 8, 8)).groupBy("subject", "region").agg(F.count("*").alias("n"), F.avg("T1").alias("t1"))
