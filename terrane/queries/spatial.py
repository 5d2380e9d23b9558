"""Label maps: volumes, interaction, fragments, regions, graphs and overlap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import spatial
from ..storage import cut
from .inputs import CELLS, cells, rounded

LABELS = (1, 2, 3, 4)


@register(
    "habitat_volume",
    f"""WITH {CELLS}, c AS (SELECT subject, label, count(*) AS n FROM cells GROUP BY ALL), s AS (SELECT DISTINCT subject FROM cells)
SELECT subject, label, coalesce(n, 0) AS voxels, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY subject), 6) AS fraction FROM (SELECT subject, unnest([1, 2, 3, 4]) AS label FROM s) g LEFT JOIN c USING (subject, label)""",
)
def habitat_volume(spark, sf_dir):
    return rounded(spatial.volumes(cells(spark, sf_dir), "subject", LABELS))


_MATRIX = f"""WITH RECURSIVE {CELLS},
o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(dz, dy, dx)),
p AS (SELECT a.subject, a.label AS i, coalesce(b.label, 0) AS j FROM cells a CROSS JOIN o LEFT JOIN cells b ON a.subject = b.subject AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
k AS (SELECT subject, i, j, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT * FROM k UNION ALL SELECT subject, 0, i, n FROM k WHERE j = 0),
box AS (SELECT subject, max(z) - min(z) + 3 AS a, max(y) - min(y) + 3 AS b, max(x) - min(x) + 3 AS c FROM cells GROUP BY 1),
matrix AS (SELECT subject, i, j, CAST(n AS BIGINT) AS n FROM m UNION ALL
  SELECT subject, 0, 0, CAST(2 * ((a - 1) * b * c + a * (b - 1) * c + a * b * (c - 1)) - (SELECT sum(n) FROM m WHERE m.subject = box.subject) AS BIGINT) FROM box)"""


@register("msi_matrix", f"{_MATRIX} SELECT subject, i, j, n FROM matrix")
def msi_matrix(spark, sf_dir):
    return spatial.interaction(cells(spark, sf_dir), "subject")


_PAIRS = [(a, b) for a in range(4) for b in range(a + 1, 4)] + [(a, a) for a in range(1, 4)]


@register(
    "msi_features",
    f"""{_MATRIX}, d AS (SELECT subject, CAST(sum(CASE WHEN i >= 1 AND j <= i THEN n ELSE 0 END) AS DOUBLE) AS d FROM matrix GROUP BY 1),
q AS (SELECT subject, i, j, n, n / d AS p FROM matrix JOIN d USING (subject)),
u AS (SELECT subject, sum(i * p) AS ux, sum(j * p) AS uy FROM q GROUP BY 1),
v AS (SELECT subject, sqrt(sum(p * (i - ux) ** 2)) AS sx, sqrt(sum(p * (j - uy) ** 2)) AS sy FROM q JOIN u USING (subject) GROUP BY 1)
SELECT subject, {", ".join(f"CAST(sum(CASE WHEN i = {a} AND j = {b} THEN n ELSE 0 END) AS DOUBLE) AS firstorder_{a}_and_{b}" for a, b in _PAIRS)}, {", ".join(f"round(sum(CASE WHEN i = {a} AND j = {b} THEN p ELSE 0 END), 6) AS firstorder_normalized_{a}_and_{b}" for a, b in _PAIRS)},
  round(sum((i - j) ** 2 * p), 6) AS contrast, round(sum(p / (1 + (i - j) ** 2)), 6) AS homogeneity, round((sum(p * i * j) - any_value(ux) * any_value(uy)) / (any_value(sx) * any_value(sy)), 6) AS correlation, round(sum(p * p), 6) AS energy
FROM q JOIN u USING (subject) JOIN v USING (subject) GROUP BY subject""",
)
def msi_features(spark, sf_dir):
    return rounded(spatial.interaction_features(spatial.interaction(cells(spark, sf_dir), "subject"), "subject", 4))


# Smallest cell number reachable over neighbours of the same label.
_COMPONENTS = f"""WITH RECURSIVE {CELLS},
n AS (SELECT subject, label, z, y, x, (z * 100 + y) * 100 + x AS id FROM cells),
o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(dz, dy, dx)),
e AS (SELECT a.subject, a.id AS u, b.id AS v FROM n a CROSS JOIN o JOIN n b ON a.subject = b.subject AND a.label = b.label AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx),
r(subject, id, root) AS (SELECT subject, id, id FROM n UNION SELECT e.subject, e.v, r.root FROM r JOIN e ON r.subject = e.subject AND r.id = e.u),
c AS (SELECT subject, id, min(root) AS component FROM r GROUP BY ALL),
comp AS (SELECT n.subject, n.label, n.z, n.y, n.x, c.component FROM n JOIN c ON n.subject = c.subject AND n.id = c.id),
size AS (SELECT subject, label, component, count(*) AS size FROM comp GROUP BY ALL),
reg AS (SELECT subject, label, count(*) AS num_regions, max(size) AS largest, CAST(sum(size) AS BIGINT) AS voxels FROM size GROUP BY ALL)"""


@register("habitat_regions", f"{_COMPONENTS} SELECT subject, label, num_regions, largest, voxels, round(1 - (largest / num_regions) / voxels, 6) AS dispersion FROM reg")
def habitat_regions(spark, sf_dir):
    return rounded(spatial.zone_regions(cells(spark, sf_dir), "subject"))


@register("habitat_ith_score", f"{_COMPONENTS} SELECT subject, round(1 - sum(largest / num_regions) / sum(voxels), 6) AS ith FROM reg GROUP BY 1")
def habitat_ith_score(spark, sf_dir):
    return rounded(spatial.fragmentation(spatial.zone_regions(cells(spark, sf_dir), "subject"), "subject"))


@register(
    "habitat_non_radiomics",
    f"{_COMPONENTS} SELECT subject, count(*) AS num_habitats, {', '.join(f'CAST(coalesce(max(CASE WHEN label = {k} THEN num_regions END), 0) AS BIGINT) AS num_regions_{k}, round(coalesce(max(CASE WHEN label = {k} THEN voxels END), 0) / sum(voxels), 6) AS volume_ratio_{k}' for k in (1, 2, 3))} FROM reg GROUP BY subject",
)
def habitat_non_radiomics(spark, sf_dir):
    reg = spatial.zone_regions(cells(spark, sf_dir), "subject")
    cols = [F.count("*").alias("num_habitats")]
    for k in (1, 2, 3):
        own = F.col("label") == k
        cols += [F.coalesce(F.max(F.when(own, F.col("num_regions"))), F.lit(0)).alias(f"num_regions_{k}"), (F.coalesce(F.max(F.when(own, F.col("voxels"))), F.lit(0)) / F.sum("voxels")).alias(f"volume_ratio_{k}")]
    return rounded(reg.groupBy("subject").agg(*cols))


_HALF = ", ".join(str(o) for o in spatial.half_offsets("corner"))


@register(
    "graph_adjacency_edges",
    f"""WITH {CELLS}, o AS (SELECT * FROM (VALUES {_HALF}) t(dz, dy, dx)), n AS (SELECT *, label * 10000 + (z // 4) * 100 + (y // 4) * 10 + x // 4 AS node FROM cells)
SELECT subject, least(a.node, b.node) AS src, greatest(a.node, b.node) AS dst, count(*) AS contact FROM n a CROSS JOIN o JOIN n b USING (subject) WHERE b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND a.node <> b.node GROUP BY ALL HAVING count(*) >= 10""",
)
def graph_adjacency_edges(spark, sf_dir):
    return spatial.contacts(_blocks(spark, sf_dir), "subject", "node")


def _blocks(spark, sf_dir):
    """Cells with a node for each label in each block of four."""
    node = F.col("label") * 10000 + F.floor(F.col("z") / 4).cast("int") * 100 + F.floor(F.col("y") / 4).cast("int") * 10 + F.floor(F.col("x") / 4).cast("int")
    return cells(spark, sf_dir).withColumn("node", node)


_BLOCKS = f"{CELLS}, n AS (SELECT *, label * 10000 + (z // 4) * 100 + (y // 4) * 10 + x // 4 AS node FROM cells)"
_CENTRES = f"{_BLOCKS}, c AS (SELECT subject, node, avg(z) AS z, avg(y) AS y, avg(x) AS x, count(*) AS voxels FROM n GROUP BY ALL)"


@register("graph_centroids", f"WITH {_CENTRES} SELECT subject, node, round(z, 6) AS z, round(y, 6) AS y, round(x, 6) AS x, voxels FROM c")
def graph_centroids(spark, sf_dir):
    return rounded(spatial.centroids(_blocks(spark, sf_dir), "subject", "node"))


_CENTROID_EDGES = f"{_CENTRES}, e AS (SELECT a.subject, a.node AS src, b.node AS dst, sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS distance FROM c a JOIN c b ON a.subject = b.subject AND a.node < b.node WHERE sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2) <= 3.0)"


@register("graph_centroid_edges", f"WITH {_CENTROID_EDGES} SELECT subject, src, dst, round(distance, 6) AS distance FROM e")
def graph_centroid_edges(spark, sf_dir):
    return rounded(spatial.centroid_edges(spatial.centroids(_blocks(spark, sf_dir), "subject", "node"), "subject", 3.0))


@register("graph_min_distance_edges", f"WITH {_BLOCKS} SELECT a.subject, a.node AS src, b.node AS dst, round(min(sqrt((a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 6) AS distance FROM n a JOIN n b ON a.subject = b.subject AND a.node < b.node WHERE (a.z - b.z) ** 2 + (a.y - b.y) ** 2 + (a.x - b.x) ** 2 <= 4 GROUP BY ALL")
def graph_min_distance_edges(spark, sf_dir):
    return rounded(spatial.closest_edges(_blocks(spark, sf_dir), "subject", "node", 2.0))


@register(
    "graph_metrics",
    f"""WITH {_CENTROID_EDGES}, d AS (SELECT c.subject, c.node, count(e.src) AS degree FROM c LEFT JOIN e ON c.subject = e.subject AND (c.node = e.src OR c.node = e.dst) GROUP BY ALL),
s AS (SELECT subject, count(*) AS num_nodes, CAST(sum(degree) / 2 AS BIGINT) AS num_edges, avg(degree) AS degree_mean, stddev_pop(degree) AS degree_std, max(degree) AS degree_max FROM d GROUP BY 1),
h AS (SELECT subject, -sum(p * log2(p + 1e-12::DOUBLE)) AS degree_entropy FROM (SELECT subject, degree, count(*) / sum(count(*)) OVER (PARTITION BY subject) AS p FROM d GROUP BY subject, degree) GROUP BY 1),
l AS (SELECT subject, avg(distance) AS m FROM e GROUP BY 1)
SELECT subject, num_nodes, num_edges, round(degree_mean, 6) AS degree_mean, round(degree_std, 6) AS degree_std, degree_max, round(degree_entropy, 6) AS degree_entropy, round(coalesce(m, 0), 6) AS edge_length_mean, round(CASE WHEN num_nodes > 1 THEN 2 * num_edges / (num_nodes * (num_nodes - 1)) ELSE 0 END, 6) AS density
FROM s JOIN h USING (subject) LEFT JOIN l USING (subject)""",
)
def graph_metrics(spark, sf_dir):
    nodes = cut(spatial.centroids(_blocks(spark, sf_dir), "subject", "node"))
    return rounded(spatial.graph_metrics(nodes, spatial.centroid_edges(nodes, "subject", 3.0), "subject"))


def _moved(spark, sf_dir):
    """The same map without its last slice, and relabelled where the second intensity is high."""
    return cells(spark, sf_dir).where("z < 7").withColumn("label", F.when(F.col("tax") > 0.06, F.col("label") % 3 + 1).otherwise(F.col("label")).cast("int"))


_MOVED = "moved AS (SELECT subject, z, y, x, CAST(CASE WHEN tax > 0.06::DOUBLE THEN label % 3 + 1 ELSE label END AS INTEGER) AS label FROM cells WHERE z < 7)"


@register("label_overlap", f"WITH {CELLS}, {_MOVED} SELECT c.subject, c.label AS label_a, m.label AS label_b, count(*) AS n FROM cells c JOIN moved m USING (subject, z, y, x) GROUP BY ALL")
def label_overlap(spark, sf_dir):
    return spatial.overlap(cells(spark, sf_dir), _moved(spark, sf_dir), "subject")


@register(
    "mask_dice",
    f"""WITH {CELLS}, {_MOVED}, a AS (SELECT subject, label, count(*) AS n FROM cells GROUP BY ALL), b AS (SELECT subject, label, count(*) AS n FROM moved GROUP BY ALL),
i AS (SELECT c.subject, c.label, count(*) AS n FROM cells c JOIN moved m USING (subject, z, y, x, label) GROUP BY ALL)
SELECT subject, label, round(2 * coalesce(i.n, 0) / (coalesce(a.n, 0) + coalesce(b.n, 0)), 6) AS dice FROM a FULL JOIN b USING (subject, label) LEFT JOIN i USING (subject, label)""",
)
def mask_dice(spark, sf_dir):
    return rounded(spatial.dice(cells(spark, sf_dir), _moved(spark, sf_dir), "subject"))


_CENTS = "CAST(sum(CAST(round({0} * 100) AS BIGINT)) AS DOUBLE) / (100 * count(*)) AS {0}"


@register("label_intensity_centroids", f"WITH {CELLS} SELECT subject, label, {_CENTS.format('price')}, {_CENTS.format('tax')} FROM cells GROUP BY ALL")
def label_intensity_centroids(spark, sf_dir):
    """Means of whole hundredths, divided once: the same double whatever the order of summation."""
    mean = lambda c: (F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / (100 * F.count("*"))).alias(c)
    return cells(spark, sf_dir).groupBy("subject", "label").agg(mean("price"), mean("tax"))


@register("label_spatial_centroids", f"WITH {CELLS} SELECT subject, label, round(avg(z), 6) AS z, round(avg(y), 6) AS y, round(avg(x), 6) AS x FROM cells GROUP BY ALL")
def label_spatial_centroids(spark, sf_dir):
    return rounded(spatial.centroids(cells(spark, sf_dir), "subject", "label").withColumnRenamed("node", "label").drop("voxels"))


@register("label_present_ids", f"WITH {CELLS} SELECT DISTINCT subject, label FROM cells WHERE label <> 0")
def label_present_ids(spark, sf_dir):
    return cells(spark, sf_dir).where("label <> 0").select("subject", "label").distinct()
