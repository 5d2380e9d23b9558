"""Texture matrices of label maps and their features."""

from __future__ import annotations

from ..catalog import register
from ..operators import texture
from ..operators.spatial import half_offsets
from .inputs import CELLS, cells, rounded

BY = ("subject",)
WIDTH = 0.02
_HALF = half_offsets("corner")
_ALL = ", ".join(map(str, _HALF + [(-a, -b, -c) for a, b, c in _HALF]))


def _levels(spark, sf_dir):
    return texture.discretise(cells(spark, sf_dir), BY, "tax", WIDTH).select("subject", "z", "y", "x", "level")


_L = f"{CELLS}, l AS (SELECT subject, z, y, x, CAST(floor(tax / 0.02::DOUBLE) - min(floor(tax / 0.02::DOUBLE)) OVER (PARTITION BY subject) + 1 AS INTEGER) AS level FROM cells), o AS (SELECT * FROM (VALUES {_ALL}) t(dz, dy, dx))"
_OFFSETS = ", ".join(f"({k}, {sign * a}, {sign * b}, {sign * c})" for k, (a, b, c) in enumerate(_HALF) for sign in (1, -1))
_GLCM = f"{_L}, g AS (SELECT * FROM (VALUES {_OFFSETS}) t(direction, dz, dy, dx)), m AS (SELECT a.subject, CAST(direction AS INTEGER) AS direction, a.level AS i, b.level AS j, count(*) AS n FROM l a CROSS JOIN g JOIN l b ON a.subject = b.subject AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL)"


@register("texture_glcm_matrix", f"WITH {_GLCM} SELECT subject, direction, i, j, n FROM m")
def texture_glcm_matrix(spark, sf_dir):
    return texture.glcm(_levels(spark, sf_dir), BY)


_NAMES = "autocorrelation joint_average cluster_prominence cluster_shade cluster_tendency contrast joint_energy joint_entropy idm idmn id idn inverse_variance maximum_probability sum_squares difference_average difference_entropy difference_variance sum_average sum_entropy correlation imc1 imc2"


@register(
    "texture_glcm_features",
    f"""WITH {_GLCM}, p AS (SELECT subject, direction, i, j, n / sum(n) OVER (PARTITION BY subject, direction) AS p FROM m), x AS (SELECT subject, direction, i, sum(p) AS px FROM p GROUP BY ALL),
u AS (SELECT subject, direction, sum(i * px) AS mu, -sum(px * log2(px + 2.2e-16::DOUBLE)) AS hx FROM x GROUP BY ALL), t AS (SELECT subject, CAST(max(level) AS DOUBLE) AS ng FROM l GROUP BY 1),
f AS (SELECT p.*, x.px, y.px AS py, mu, hx, ng FROM p JOIN x USING (subject, direction, i) JOIN x y ON p.subject = y.subject AND p.direction = y.direction AND p.j = y.i JOIN u ON p.subject = u.subject AND p.direction = u.direction JOIN t ON p.subject = t.subject),
a AS (SELECT subject, direction, sum(i * j * p) AS autocorrelation, any_value(mu) AS joint_average, sum((i + j - 2 * mu) ** 4 * p) AS cluster_prominence, sum((i + j - 2 * mu) ** 3 * p) AS cluster_shade, sum((i + j - 2 * mu) ** 2 * p) AS cluster_tendency, sum((i - j) ** 2 * p) AS contrast, sum(p * p) AS joint_energy, -sum(p * log2(p + 2.2e-16::DOUBLE)) AS joint_entropy,
  sum(p / (1 + (i - j) ** 2)) AS idm, sum(p / (1 + (i - j) ** 2 / ng ** 2)) AS idmn, sum(p / (1 + abs(i - j))) AS id, sum(p / (1 + abs(i - j) / ng)) AS idn, sum(CASE WHEN i <> j THEN p / (i - j) ** 2 ELSE 0 END) AS inverse_variance, max(p) AS maximum_probability, sum((i - mu) ** 2 * p) AS sum_squares, sum((i - mu) * (j - mu) * p) AS cov, -sum(p * log2(px * py + 2.2e-16::DOUBLE)) AS hxy1, any_value(hx) AS hx FROM f GROUP BY ALL),
h AS (SELECT a.subject, a.direction, -sum(a.px * b.px * log2(a.px * b.px + 2.2e-16::DOUBLE)) AS hxy2 FROM x a JOIN x b USING (subject, direction) GROUP BY ALL),
d AS (SELECT subject, direction, sum(k * p) AS difference_average, -sum(p * log2(p + 2.2e-16::DOUBLE)) AS difference_entropy, sum(k * k * p) - sum(k * p) ** 2 AS difference_variance FROM (SELECT subject, direction, abs(i - j) AS k, sum(p) AS p FROM p GROUP BY ALL) GROUP BY ALL),
s AS (SELECT subject, direction, sum(k * p) AS sum_average, -sum(p * log2(p + 2.2e-16::DOUBLE)) AS sum_entropy FROM (SELECT subject, direction, i + j AS k, sum(p) AS p FROM p GROUP BY ALL) GROUP BY ALL),
e AS (SELECT *, CASE WHEN sum_squares > 0 THEN cov / sum_squares ELSE 1 END AS correlation, CASE WHEN hx <> 0 THEN (joint_entropy - hxy1) / hx ELSE 0 END AS imc1, sqrt(greatest(1 - exp(-2 * (hxy2 - joint_entropy)), 0.0)) AS imc2 FROM a JOIN d USING (subject, direction) JOIN s USING (subject, direction) JOIN h USING (subject, direction))
SELECT subject, {", ".join(f"round(avg({x}), 5) AS {x}" for x in _NAMES.split())} FROM e GROUP BY 1""",
)
def texture_glcm_features(spark, sf_dir):
    levels = _levels(spark, sf_dir)
    return rounded(texture.glcm_features(texture.glcm(levels, BY), BY, levels), 5)


_GLDM = f"{_L}, d AS (SELECT a.subject, a.level, a.z, a.y, a.x, 1 + count(b.subject) AS size FROM l a CROSS JOIN o LEFT JOIN l b ON a.subject = b.subject AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND a.level = b.level GROUP BY ALL), m AS (SELECT subject, level, CAST(size AS INTEGER) AS size, count(*) AS n FROM d GROUP BY ALL)"


@register("texture_gldm_matrix", f"WITH {_GLDM} SELECT subject, level, size, n FROM m")
def texture_gldm_matrix(spark, sf_dir):
    return texture.gldm(_levels(spark, sf_dir), BY)


_SIZES = """t AS (SELECT subject, sum(n) AS t FROM m GROUP BY 1), q AS (SELECT m.*, CAST(level AS DOUBLE) AS g, CAST(size AS DOUBLE) AS s, n / t AS p, t FROM m JOIN t USING (subject)),
gl AS (SELECT subject, sum(c * c) / sum(c) AS v FROM (SELECT subject, level, sum(n) AS c FROM m GROUP BY ALL) GROUP BY 1), sz AS (SELECT subject, sum(c * c) / sum(c) AS v FROM (SELECT subject, size, sum(n) AS c FROM m GROUP BY ALL) GROUP BY 1), c AS (SELECT subject, count(*) AS c FROM l GROUP BY 1)
SELECT subject, round(sum(p / (s * s)), 6) AS small_emphasis, round(sum(p * s * s), 6) AS large_emphasis, round(sum(p / (g * g)), 6) AS low_level_emphasis, round(sum(p * g * g), 6) AS high_level_emphasis, round(sum(p / (s * s * g * g)), 6) AS small_low_emphasis, round(sum(p * g * g / (s * s)), 6) AS small_high_emphasis, round(sum(p * s * s / (g * g)), 6) AS large_low_emphasis, round(sum(p * s * s * g * g), 6) AS large_high_emphasis,
  round(sum(p * g * g) - sum(p * g) ** 2, 6) AS level_variance, round(sum(p * s * s) - sum(p * s) ** 2, 6) AS size_variance, round(-sum(p * log2(p + 2.2e-16::DOUBLE)), 6) AS size_entropy, round(any_value(gl.v), 6) AS level_nonuniformity, round(any_value(sz.v), 6) AS size_nonuniformity, round(any_value(gl.v) / any_value(t), 6) AS level_nonuniformity_normalized, round(any_value(sz.v) / any_value(t), 6) AS size_nonuniformity_normalized, round(any_value(t) / any_value(c), 6) AS percentage
FROM q JOIN gl USING (subject) JOIN sz USING (subject) JOIN c USING (subject) GROUP BY subject"""


@register("texture_gldm_features", f"WITH {_GLDM}, {_SIZES}")
def texture_gldm_features(spark, sf_dir):
    return rounded(texture.features(_levels(spark, sf_dir), BY, "gldm"))


_RUNS = f"""{_L}, h AS (SELECT row_number() OVER () - 1 AS direction, * FROM (VALUES {", ".join(map(str, _HALF))}) t(dz, dy, dx)),
e AS (SELECT a.subject, a.level, h.direction, a.z, a.y, a.x, dz, dy, dx FROM l a CROSS JOIN h LEFT JOIN l b ON a.subject = b.subject AND b.z = a.z - dz AND b.y = a.y - dy AND b.x = a.x - dx AND a.level = b.level WHERE b.subject IS NULL),
r(subject, level, direction, z, y, x, dz, dy, dx, size) AS (SELECT subject, level, direction, z, y, x, dz, dy, dx, 1 FROM e UNION ALL SELECT r.subject, r.level, r.direction, b.z, b.y, b.x, dz, dy, dx, size + 1 FROM r JOIN l b ON r.subject = b.subject AND b.z = r.z + dz AND b.y = r.y + dy AND b.x = r.x + dx AND r.level = b.level),
w AS (SELECT subject, level, direction, z - (size - 1) * dz AS z0, y - (size - 1) * dy AS y0, x - (size - 1) * dx AS x0, max(size) AS size FROM r GROUP BY ALL),
runs AS (SELECT subject, CAST(direction AS INTEGER) AS direction, level, CAST(size AS INTEGER) AS size, count(*) AS n FROM w GROUP BY ALL)"""


@register("texture_glrlm_matrix", f"WITH RECURSIVE {_RUNS} SELECT subject, direction, level, size, n FROM runs")
def texture_glrlm_matrix(spark, sf_dir):
    return texture.glrlm(_levels(spark, sf_dir), BY)


_RUN_NAMES = "small_emphasis large_emphasis low_level_emphasis high_level_emphasis small_low_emphasis small_high_emphasis large_low_emphasis large_high_emphasis level_variance size_variance size_entropy level_nonuniformity size_nonuniformity level_nonuniformity_normalized size_nonuniformity_normalized percentage"


@register(
    "texture_glrlm_features",
    f"""WITH RECURSIVE {_RUNS}, m AS (SELECT * FROM runs), t AS (SELECT subject, direction, sum(n) AS t, sum(n * size) AS c FROM m GROUP BY ALL), q AS (SELECT m.*, CAST(level AS DOUBLE) AS g, CAST(size AS DOUBLE) AS s, n / t AS p, t, c FROM m JOIN t USING (subject, direction)),
gl AS (SELECT subject, direction, sum(c * c) / sum(c) AS v FROM (SELECT subject, direction, level, sum(n) AS c FROM m GROUP BY ALL) GROUP BY ALL), sz AS (SELECT subject, direction, sum(c * c) / sum(c) AS v FROM (SELECT subject, direction, size, sum(n) AS c FROM m GROUP BY ALL) GROUP BY ALL),
by_run AS (SELECT q.subject, q.direction, sum(p / (s * s)) AS small_emphasis, sum(p * s * s) AS large_emphasis, sum(p / (g * g)) AS low_level_emphasis, sum(p * g * g) AS high_level_emphasis, sum(p / (s * s * g * g)) AS small_low_emphasis, sum(p * g * g / (s * s)) AS small_high_emphasis, sum(p * s * s / (g * g)) AS large_low_emphasis, sum(p * s * s * g * g) AS large_high_emphasis,
  sum(p * g * g) - sum(p * g) ** 2 AS level_variance, sum(p * s * s) - sum(p * s) ** 2 AS size_variance, -sum(p * log2(p + 2.2e-16::DOUBLE)) AS size_entropy, any_value(gl.v) AS level_nonuniformity, any_value(sz.v) AS size_nonuniformity, any_value(gl.v) / any_value(t) AS level_nonuniformity_normalized, any_value(sz.v) / any_value(t) AS size_nonuniformity_normalized, any_value(t) / any_value(c) AS percentage
  FROM q JOIN gl USING (subject, direction) JOIN sz USING (subject, direction) GROUP BY ALL)
SELECT subject, {", ".join(f"round(avg({x}), 5) AS {x}" for x in _RUN_NAMES.split())} FROM by_run GROUP BY 1""",
)
def texture_glrlm_features(spark, sf_dir):
    return rounded(texture.features(_levels(spark, sf_dir), BY, "glrlm"), 5)


# A recursive SQL walk over zones takes minutes on whole tables: small maps are held against brute force in the tests.
@register("texture_glszm_matrix")
def texture_glszm_matrix(spark, sf_dir):
    return texture.glszm(_levels(spark, sf_dir), BY)


@register("texture_glszm_features")
def texture_glszm_features(spark, sf_dir):
    return rounded(texture.features(_levels(spark, sf_dir), BY, "glszm"))


_NGTDM = f"{_L}, a AS (SELECT a.subject, a.level, a.z, a.y, a.x, avg(b.level) AS m FROM l a CROSS JOIN o JOIN l b ON a.subject = b.subject AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL), g AS (SELECT subject, level, count(*) AS n, sum(abs(level - m)) AS s FROM a GROUP BY ALL)"


@register("texture_ngtdm_matrix", f"WITH {_NGTDM} SELECT subject, level, n, round(s, 6) AS s FROM g")
def texture_ngtdm_matrix(spark, sf_dir):
    return rounded(texture.ngtdm(_levels(spark, sf_dir), BY))


@register(
    "texture_ngtdm_features",
    f"""WITH {_NGTDM}, r AS (SELECT subject, CAST(level AS DOUBLE) AS i, n, s, n / sum(n) OVER (PARTITION BY subject) AS p FROM g),
t AS (SELECT a.subject, sum(a.p * b.p * (a.i - b.i) ** 2) AS c, sum(abs(a.i * a.p - b.i * b.p)) AS b, sum(abs(a.i - b.i) * (a.p * a.s + b.p * b.s) / (a.p + b.p)) AS x, sum((a.p + b.p) * (a.i - b.i) ** 2) AS t FROM r a JOIN r b USING (subject) GROUP BY 1),
u AS (SELECT subject, sum(p * s) AS ps, sum(s) AS s, sum(n) AS n, count(*) AS g FROM r GROUP BY 1)
SELECT subject, round(least(1 / ps, 1e6::DOUBLE), 6) AS coarseness, round(c / (g * (g - 1)) * s / n, 6) AS contrast, round(ps / b, 6) AS busyness, round(x / n, 6) AS complexity, round(t / s, 6) AS strength FROM t JOIN u USING (subject)""",
)
def texture_ngtdm_features(spark, sf_dir):
    return rounded(texture.features(_levels(spark, sf_dir), BY, "ngtdm"))
