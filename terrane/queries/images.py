"""Image preprocessing and perturbation over label maps with intensities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import register
from ..operators import images
from .inputs import CELLS, cells, rounded

BY = ("subject",)


@register("image_zscore", f"WITH {CELLS} SELECT subject, z, y, x, round(least(greatest((price - avg(price) OVER w) / stddev_pop(price) OVER w, -2.0), 2.0), 6) AS price FROM cells WINDOW w AS (PARTITION BY subject)")
def image_zscore(spark, sf_dir):
    out = images.zscore(cells(spark, sf_dir), BY, "price", clip=(-2, 2))
    return rounded(out.select("subject", "z", "y", "x", "price"))


@register("image_zscore_in_mask", f"WITH {CELLS} SELECT subject, z, y, x, round((price - avg(price) FILTER (label = 1) OVER w) / stddev_pop(price) FILTER (label = 1) OVER w, 6) AS price FROM cells WINDOW w AS (PARTITION BY subject)")
def image_zscore_in_mask(spark, sf_dir):
    out = images.zscore(cells(spark, sf_dir).withColumn("mask", (F.col("label") == 1).cast("int")), BY, "price", "mask")
    return rounded(out.select("subject", "z", "y", "x", "price"))


_M = images.LANDMARKS
_T = [(p - _M[0]) / (_M[-1] - _M[0]) * 100 for p in _M]


def _pieces() -> str:
    cases = [f"WHEN price <= m[1] THEN price * {_T[0]}::DOUBLE / m[1]"]
    for k in range(len(_M) - 1):
        body = f"price * (({_T[k + 1]!r}::DOUBLE - {_T[k]!r}::DOUBLE) / (m[{k + 2}] - m[{k + 1}])) + ({_T[k]!r}::DOUBLE - (({_T[k + 1]!r}::DOUBLE - {_T[k]!r}::DOUBLE) / (m[{k + 2}] - m[{k + 1}])) * m[{k + 1}])"
        cases.append(f"{'WHEN price <= m[' + str(k + 2) + '] THEN' if k < len(_M) - 2 else 'ELSE'} {body}")
    return " ".join(cases)


@register("image_histogram_standardisation", f"WITH {CELLS}, q AS (SELECT subject, quantile_cont(price, [{', '.join(str(p / 100) for p in _M)}]) AS m FROM cells WHERE price > 0 GROUP BY 1) SELECT subject, z, y, x, round(CASE {_pieces()} END, 6) AS price FROM cells JOIN q USING (subject)")
def image_histogram_standardisation(spark, sf_dir):
    return rounded(images.standardise(cells(spark, sf_dir), BY, "price").select("subject", "z", "y", "x", "price"))


@register("image_reorient", f"WITH {CELLS} SELECT subject, label, CAST(max(y) OVER w + min(y) OVER w - y AS INTEGER) AS x, x AS y, z FROM cells WINDOW w AS (PARTITION BY subject)")
def image_reorient(spark, sf_dir):
    return images.reorient(cells(spark, sf_dir).select("subject", "label", "z", "y", "x"), BY, "LPS", "ALS")


@register("image_resample_nearest", f"WITH {CELLS}, g AS (SELECT unnest(range(0, 30)) AS i) SELECT c.subject, c.label, CAST(a.i AS INTEGER) AS z, c.y, CAST(b.i AS INTEGER) AS x FROM cells c JOIN g a ON a.i * 0.5 >= c.z - 0.5 AND a.i * 0.5 < c.z + 0.5 JOIN g b ON b.i * 2.0 >= c.x - 0.5 AND b.i * 2.0 < c.x + 0.5")
def image_resample_nearest(spark, sf_dir):
    return images.resample_nearest(cells(spark, sf_dir).select("subject", "label", "z", "y", "x"), BY, (1.0, 1.0, 1.0), (0.5, 1.0, 2.0))


_O = "o AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) t(dz, dy, dx))"
_ERODED = f"{CELLS}, {_O}, one AS (SELECT subject, z, y, x FROM cells WHERE label <= 2), er AS (SELECT a.subject, a.z, a.y, a.x FROM one a CROSS JOIN o JOIN one b ON a.subject = b.subject AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY ALL HAVING count(*) = 6)"
_GROWN = f"{_ERODED}, gr AS (SELECT subject, CAST(z + dz AS INTEGER) AS z, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM one CROSS JOIN o UNION SELECT subject, z, y, x FROM one)"


def _mask(spark, sf_dir):
    return cells(spark, sf_dir).where("label <= 2").withColumn("label", F.lit(1))


@register("mask_erode", f"WITH {_ERODED} SELECT * FROM er")
def mask_erode(spark, sf_dir):
    return images.erode(_mask(spark, sf_dir), BY).drop("label")


@register("mask_dilate", f"WITH {_GROWN} SELECT * FROM gr")
def mask_dilate(spark, sf_dir):
    return images.dilate(_mask(spark, sf_dir), BY).drop("label")


@register("mask_boundary_band", f"WITH {_GROWN} SELECT * FROM gr EXCEPT SELECT * FROM er")
def mask_boundary_band(spark, sf_dir):
    return images.boundary(_mask(spark, sf_dir), BY)


@register("mask_slice_extent", f"WITH {CELLS}, b AS (SELECT subject, min(z) AS a, max(z) AS b FROM cells GROUP BY 1) SELECT subject, z, y, x, label FROM cells JOIN b USING (subject) WHERE z >= a + 1 AND z <= b.b - 1 UNION ALL SELECT subject, CAST(z - 1 AS INTEGER), y, x, label FROM cells JOIN b USING (subject) WHERE z = a UNION ALL SELECT subject, CAST(z + 1 AS INTEGER), y, x, label FROM cells JOIN b USING (subject) WHERE z = b.b")
def mask_slice_extent(spark, sf_dir):
    return images.slice_extent(cells(spark, sf_dir).select("subject", "z", "y", "x", "label"), BY, shrink=1, grow=1)


@register("image_translate", f"WITH {CELLS}, s AS (SELECT subject, CAST(z + dz AS INTEGER) AS z, y, CAST(x + dx AS INTEGER) AS x, tax * w AS v FROM cells, (VALUES (0, 1, 0.375::DOUBLE), (0, 2, 0.125::DOUBLE), (1, 1, 0.375::DOUBLE), (1, 2, 0.125::DOUBLE)) t(dz, dx, w)), g AS (SELECT subject, z, y, x, sum(v) AS tax FROM s GROUP BY ALL) SELECT subject, z, y, x, round(g.tax, 6) AS tax FROM g SEMI JOIN cells USING (subject, z, y, x)")
def image_translate(spark, sf_dir):
    return rounded(images.translate(cells(spark, sf_dir), BY, "tax", (0.5, 0.0, 1.25)))


@register("image_gaussian_noise")
def image_gaussian_noise(spark, sf_dir):
    return images.gaussian_noise(cells(spark, sf_dir), BY, "price", 10.0).select("subject", "z", "y", "x", "price")
