"""WARC fixity audit with Merkle trees, in SQL functions only.

An archive is an ordered run of WARC records.  Every record has an offset (the
summed lengths before it), belongs to one offset range and is hashed; a range's node
hashes its records' offsets, lengths and digests in order, and each level above
hashes ``fanout`` neighbouring nodes until one root stands for the archive.  Two
replicas are compared root against root, and only children of nodes that differ are
joined on the way down to the damaged records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

RANGE_BYTES = 16 * 1024
FANOUT = 4
RECORDS_PER_ARCHIVE = 256
#: A record takes at least so much room in a range, so that empty ones can't crowd it.
LEAST_BYTES = 64
#: Pages without an id are dealt by their content to archives below this number.
UNNUMBERED = -(1 << 40)


def record_text(url: Column, payload: Column, page_id: Column) -> Column:
    """A WARC/1.1 resource record of a page; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, per_archive: int = RECORDS_PER_ARCHIVE) -> DataFrame:
    """(archive, record, data) of pages (page_id, url, html); an archive holds the pages of ``per_archive`` neighbouring ids.

    A null page_id is told by its content: archive and record are both a number below
    UNNUMBERED taken from the record's digest, so such pages spread over many archives
    and clash with no id.  Negative ids are ids like any other.  Extra columns are ignored.
    """
    data = record_text(F.col("url"), F.col("html"), F.col("page_id"))
    lost = F.lit(UNNUMBERED) - F.conv(F.substring(F.sha2(data, 256), 1, 6), 16, 10).cast("long")
    number = F.col("page_id").cast("long")
    return pages.select(F.coalesce(F.floor(number / per_archive).cast("long"), lost).alias("archive"), F.coalesce(number, lost).alias("record"), data.alias("data"))


def leaves(archive_records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(archive, record, copy, start, size, digest, node) of records (archive, record, data).

    Records are ordered by number and, where numbers repeat, by digest; ``copy``
    counts equal numbers from 1.  Only sizes and digests are shuffled, never data.
    ``start`` is a record's true offset; its range (``node``) counts every record as
    LEAST_BYTES at least, so a range holds a bounded number of records.
    """
    hashed = archive_records.select("archive", "record", F.octet_length(F.coalesce("data", F.lit(""))).cast("long").alias("size"), F.sha2(F.coalesce("data", F.lit("")), 256).alias("digest"))
    order = Window.partitionBy("archive").orderBy("record", "digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("copy", F.row_number().over(Window.partitionBy("archive", "record").orderBy("digest")))
    return placed.withColumn("node", F.floor(F.coalesce(F.sum(F.greatest("size", F.lit(LEAST_BYTES))).over(before), F.lit(0)) / range_bytes).cast("long")).select("archive", "record", "copy", "start", "size", "digest", "node")


def _ordered(parts: Column) -> Column:
    """SHA-256 over (place, text) structs in the order of their places."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["text"]), "\n"), 256)


def tree(archive_leaves: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels (archive, node, digest) from the ranges up to the roots; a node's children are bounded by the range or the fanout.

    Each level is cut to the shared folder: it is small, and the descent reads it twice.
    """
    line = F.concat_ws(":", *(F.col(c).cast("string") for c in ("start", "size", "record", "copy", "digest")))
    levels = [cut(archive_leaves.groupBy("archive", "node").agg(_ordered(F.struct(F.col("start").alias("place"), F.col("record").alias("also"), F.col("copy").alias("then"), line.alias("text"))).alias("digest")))]
    for _ in range(height):
        child = F.struct(F.col("node").alias("place"), F.concat_ws(":", F.col("node").cast("string"), F.col("digest")).alias("text"))
        levels.append(cut(levels[-1].groupBy("archive", F.floor(F.col("node") / fanout).cast("long").alias("up")).agg(_ordered(child).alias("digest")).withColumnRenamed("up", "node")))
    return levels


def _differ(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    joined = a.select(*keys, F.col("digest").alias("mine")).join(b.select(*keys, F.col("digest").alias("other")), keys, "full_outer")
    return joined.where(~F.col("mine").eqNullSafe(F.col("other")))


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per damaged record: archive, record, copy, status (changed, missing, added), its start, size and digest in the primary and in the replica.

    Records are (archive, record, data); null data is empty.  Identical replicas and
    empty tables give no rows.  A record that only moved because one before it
    changed its length is intact and not listed.  Repeated records are told apart by
    ``copy``, counted in digest order.
    """
    sides = [cut(leaves(x, range_bytes)) for x in (primary, replica)]
    last = max((x.agg(F.max("node")).first()[0] or 0) for x in sides)
    height = 0
    while last >= fanout**height:
        height += 1
    mine, other = (tree(x, height, fanout) for x in sides)
    bad = cut(_differ(mine[-1], other[-1], ["archive", "node"]).select("archive", "node"))
    for low_mine, low_other in zip(mine[-2::-1], other[-2::-1], strict=True):
        up = bad.select("archive", F.col("node").alias("up"))
        below = []
        for low in (low_mine, low_other):
            low = low.withColumn("up", F.floor(F.col("node") / fanout).cast("long"))
            below.append(low.join(up, ["archive", "up"], "left_semi").drop("up"))
        bad = cut(_differ(*below, ["archive", "node"]).select("archive", "node"))
    kept = [x.join(bad, ["archive", "node"], "left_semi") for x in sides]
    a, b = (x.select("archive", "record", "copy", *(F.col(c).alias(f"{side}_{c}") for c in ("start", "size", "digest"))) for x, side in zip(kept, ("primary", "replica"), strict=True))
    both = a.join(b, ["archive", "record", "copy"], "full_outer").where(~F.col("primary_digest").eqNullSafe(F.col("replica_digest")))
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("primary_digest").isNull(), "added").otherwise("changed")
    return both.select("archive", "record", "copy", status.alias("status"), "primary_start", "primary_size", "primary_digest", "replica_start", "replica_size", "replica_digest")


def drill(archive_records: DataFrame) -> DataFrame:
    """A replica with known damage: of each 97 records one is altered in place, one grows by a byte; of each 389 one is lost."""
    n = F.col("record")
    data = F.when(F.pmod(n, F.lit(97)) == 13, F.replace("data", F.lit("WARC/1.1"), F.lit("WARC/1.0"))).when(F.pmod(n, F.lit(97)) == 14, F.concat("data", F.lit("?"))).otherwise(F.col("data"))
    return archive_records.where(F.pmod(n, F.lit(389)) != 7).withColumn("data", data)


#: The drill's audit in DuckDB SQL, by comparing every record.
ORACLE = f"""
WITH p AS (
  SELECT page_id AS number, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS data FROM pages),
q AS (SELECT coalesce(number, {UNNUMBERED} - CAST('0x' || substr(sha256(data), 1, 6) AS BIGINT)) AS record, CAST(coalesce(floor(number / {RECORDS_PER_ARCHIVE}.0), {UNNUMBERED} - CAST('0x' || substr(sha256(data), 1, 6) AS BIGINT)) AS BIGINT) AS archive, data FROM p),
r AS (
  SELECT archive, record, CASE WHEN pm97 = 13 THEN replace(data, 'WARC/1.1', 'WARC/1.0') WHEN pm97 = 14 THEN data || '?' ELSE data END AS data
  FROM (SELECT *, (record % 97 + 97) % 97 AS pm97 FROM q) WHERE (record % 389 + 389) % 389 <> 7),
pl AS (SELECT archive, record, CAST(strlen(data) AS BIGINT) AS size, sha256(data) AS digest FROM q),
rl AS (SELECT archive, record, CAST(strlen(data) AS BIGINT) AS size, sha256(data) AS digest FROM r),
ps AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY archive ORDER BY record, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, row_number() OVER (PARTITION BY archive, record ORDER BY digest) AS copy FROM pl),
rs AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY archive ORDER BY record, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, row_number() OVER (PARTITION BY archive, record ORDER BY digest) AS copy FROM rl)
SELECT coalesce(ps.archive, rs.archive) AS archive, coalesce(ps.record, rs.record) AS record, CAST(coalesce(ps.copy, rs.copy) AS INTEGER) AS copy,
  CASE WHEN rs.digest IS NULL THEN 'missing' WHEN ps.digest IS NULL THEN 'added' ELSE 'changed' END AS status,
  ps.start AS primary_start, ps.size AS primary_size, ps.digest AS primary_digest, rs.start AS replica_start, rs.size AS replica_size, rs.digest AS replica_digest
FROM ps FULL JOIN rs ON ps.archive = rs.archive AND ps.record = rs.record AND ps.copy = rs.copy
WHERE ps.digest IS DISTINCT FROM rs.digest
"""
