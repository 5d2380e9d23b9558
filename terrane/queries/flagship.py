"""The flagship: scale every supplier's units, assign them to regions, and return the regions' shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import cluster, prep, spatial
from ..storage import cut
from .inputs import rounded, units

FEATURES = ("l_quantity", "l_extendedprice", "l_discount")
CENTROIDS = ((0.2, 0.2, 0.3), (0.5, 0.5, 0.5), (0.8, 0.8, 0.7))


def _clipped(c: str) -> str:
    return f"least(greatest({c}, quantile_cont({c}, 0.05) OVER w), quantile_cont({c}, 0.95) OVER w) AS {c}"


def _scaled(c: str) -> str:
    return f"({c} - min({c}) OVER w) / (CASE WHEN max({c}) OVER w = min({c}) OVER w THEN 1.0 ELSE max({c}) OVER w - min({c}) OVER w END) AS {c}"


def _distance(centroid: tuple[float, ...]) -> str:
    return " + ".join(f"({c} - {v}::DOUBLE) * ({c} - {v}::DOUBLE)" for c, v in zip(FEATURES, centroid, strict=True))


@register(
    "flagship",
    f"""WITH a AS (SELECT l_suppkey, {", ".join(map(_clipped, FEATURES))} FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)), b AS (SELECT l_suppkey, {", ".join(map(_scaled, FEATURES))} FROM a WINDOW w AS (PARTITION BY l_suppkey)),
d AS (SELECT l_suppkey, [{", ".join(map(_distance, CENTROIDS))}] AS d FROM b), h AS (SELECT l_suppkey, CAST(list_position(d, list_min(d)) AS INTEGER) AS habitat FROM d), n AS (SELECT l_suppkey, habitat, count(*) AS n FROM h GROUP BY ALL), s AS (SELECT DISTINCT l_suppkey FROM h)
SELECT g.l_suppkey, g.habitat, coalesce(n.n, 0) AS voxels, round(coalesce(n.n, 0) / sum(coalesce(n.n, 0)) OVER (PARTITION BY g.l_suppkey), 6) AS fraction FROM (SELECT l_suppkey, unnest([1, 2, 3]) AS habitat FROM s) g LEFT JOIN n ON g.l_suppkey = n.l_suppkey AND g.habitat = n.habitat""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units(spark, sf_dir).select("l_suppkey", *FEATURES)
    for method in (prep.winsorize(), prep.minmax()):
        state = cut(prep.fit(rows, FEATURES, method, ["l_suppkey"]))
        rows = prep.apply(rows, state, FEATURES, method, ["l_suppkey"])
    regions = cluster.nearest(rows, FEATURES, CENTROIDS).withColumnRenamed("habitat", "label")
    return rounded(spatial.volumes(regions.select("l_suppkey", "label"), "l_suppkey", (1, 2, 3)).withColumnRenamed("label", "habitat")).select("l_suppkey", F.col("habitat"), "voxels", "fraction")
