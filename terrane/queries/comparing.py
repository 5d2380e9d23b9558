"""Radiomics tables by kind of region, and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import radiomics
from ..plans import comparison
from .evaluation import _COUNTS, _panel_sql
from .inputs import PREDICTIONS, cells, predictions, rounded

WIDTH = 0.02


@register("radiomics_whole_region")
def radiomics_whole_region(spark, sf_dir):
    return radiomics.features(cells(spark, sf_dir), ["subject"], "tax", WIDTH, ["subject"])


@register("radiomics_label_map")
def radiomics_label_map(spark, sf_dir):
    """The label map itself taken as the image."""
    c = cells(spark, sf_dir).withColumn("v", F.col("label").cast("double"))
    return radiomics.features(c, ["subject"], "v", 1.0, ["subject"])


@register("radiomics_each_habitat")
def radiomics_each_habitat(spark, sf_dir):
    return radiomics.each_label(cells(spark, sf_dir), "subject", "label", "tax", WIDTH, (1, 2, 3, 4))


@register("radiomics_supervoxel")
def radiomics_supervoxel(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("unit", F.col("z"))
    return radiomics.features(c, ["subject", "unit"], "tax", WIDTH, ["subject"])


@register("radiomics_voxel")
def radiomics_voxel(spark, sf_dir):
    return radiomics.voxel_features(cells(spark, sf_dir), "subject", "tax", WIDTH, 1, radiomics.FAMILIES)


_LONG = f"{PREDICTIONS}, l AS (SELECT split, y, 'p' AS model, p FROM predictions UNION ALL SELECT split, y, 'p2', p2 FROM predictions)"


@register("compare_panels", f"WITH {_LONG}, c AS (SELECT split, model, {_COUNTS.format(t=0.5)} FROM l GROUP BY ALL), k AS (SELECT split, model, y, rank() OVER (PARTITION BY split, model ORDER BY p) + (count(*) OVER (PARTITION BY split, model, p) - 1) / 2.0 AS r FROM l), a AS (SELECT split, model, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y <> 1)), 6) AS auc FROM k GROUP BY ALL) SELECT split, model, {_panel_sql('c')}, auc FROM c JOIN a USING (split, model)")
def compare_panels(spark, sf_dir):
    return rounded(comparison.panels(predictions(spark, sf_dir), ("p", "p2"), "y", "split"))


@register("compare_transferred_thresholds", f"WITH {_LONG}, k AS (SELECT model, p AS threshold, count(*) FILTER (y = 1) AS a, count(*) FILTER (y <> 1) AS b FROM l WHERE split = 'train' GROUP BY ALL), j AS (SELECT model, threshold, sum(a) OVER w / sum(a) OVER g - sum(b) OVER w / sum(b) OVER g AS v FROM k WINDOW w AS (PARTITION BY model ORDER BY threshold DESC), g AS (PARTITION BY model)), t AS (SELECT model, threshold FROM j QUALIFY row_number() OVER (PARTITION BY model ORDER BY round(v, 12) DESC, threshold DESC) = 1), c AS (SELECT split, model, threshold, {_COUNTS.format(t='threshold')} FROM l JOIN t USING (model) GROUP BY ALL) SELECT split, model, threshold, {_panel_sql('c')} FROM c")
def compare_transferred_thresholds(spark, sf_dir):
    return rounded(comparison.transferred(predictions(spark, sf_dir), ("p", "p2"), "y", "split"))


@register("compare_closest_threshold")
def compare_closest_threshold(spark, sf_dir):
    return comparison.closest_to_targets(predictions(spark, sf_dir), "y", "p", {"sensitivity": 0.99, "specificity": 0.99})


@register("compare_pairwise_auc")
def compare_pairwise_auc(spark, sf_dir):
    rows = comparison.pairwise(predictions(spark, sf_dir), ("p", "p2"), "y", "id")
    return spark.createDataFrame([(r["a"], r["b"], r["auc_a"], r["auc_b"], r["z"], r["p"]) for r in rows], "a string, b string, auc_a double, auc_b double, z double, p double")
