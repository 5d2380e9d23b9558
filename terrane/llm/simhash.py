"""SimHash near-duplicates by pigeonring filtering.

The 64 bits lie on a ring of three segments (22, 21 and 21 bits).  Two
fingerprints within two bits have a start i from which the cumulative
differences stay within the proportional budgets 2/3, 4/3 and 6/3, that is
0, 1 and 2 whole bits.  The chain is grown in two steps and the first prunes before
the second is paid for:

1. segment i equal and at most one bit off in segment i + 1: a fingerprint goes on
   from start i only if another distinct one shares a key with one bit of segment
   i + 1 blanked.  (Segment i alone would prune well on small inputs only: 22 bits
   fill up as the input grows, 43 do not.)
2. the full check: two fingerprints are within two bits exactly if they share a
   value that is at most one flipped bit from either, so survivors meet at those
   values.  A meeting point can have 65 fingerprints at most and becomes a star.

No pair inside a group is ever spelled out: the work is linear in the number of
distinct fingerprints, and copies collapse to one fingerprint beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import cut
from .text import _SPACE, Words, slices

WORDS = 3
SEED = 42
#: (first bit, bits) of each segment of the ring.
RING = ((0, 22), (22, 21), (43, 21))


def fingerprints_of(texts: pa.Array, shingle: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    w = Words(texts, lower=True)
    keep = ~_SPACE[w.data]
    keep[w.ends] = True
    joined = w.data[keep]
    joined[_SPACE[joined]] = 0x20
    joined = joined.tobytes()
    size = w.ends - w.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = w.n_words
    some = np.flatnonzero(n)
    per_doc = np.maximum(n[some] - shingle + 1, 1)
    first = np.repeat(w.off[:-1][some], per_doc) + np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    last = np.minimum(first + shingle, np.repeat(w.off[1:][some], per_doc)) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)), np.uint64, len(first))
    out = np.zeros(w.n_docs, np.uint64)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(per_doc) - per_doc, axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > per_doc[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of every row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprints_of(part.column("text"), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _flag(bit: int) -> int:
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def _bits(i: int) -> range:
    low, bits = RING[i % 3]
    return range(low, low + bits)


def _chain_keys(fp: Column) -> Column:
    """The keys of all chains of two segments from every start: 43 bits of the two, one bit of the second blanked, and which."""
    keys = []
    for i in range(3):
        (low, bits), (after, more) = RING[i], RING[(i + 1) % 3]
        first = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))
        second = F.shiftrightunsigned(fp, after).bitwiseAND(F.lit((1 << more) - 1))
        both = first.bitwiseOR(F.shiftleft(second, bits))
        keys += (both.bitwiseAND(F.lit(~(1 << (bits + b)))).bitwiseOR(F.lit((3 * b + i) << 44)) for b in range(more))
    return F.array(*keys)


def links(fps: DataFrame) -> DataFrame:
    """Star edges (u, v) that connect exactly the distinct fingerprints (fp long) linked at two or fewer differing bits."""
    fp = F.col("fp")
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = spread.select("fp", F.explode(_chain_keys(fp)).alias("key"))
    # fingerprints are distinct, so a neighbour under the same key is another one
    beside = Window.partitionBy("key").orderBy("fp")
    met = keyed.withColumns({"before": F.lag("fp").over(beside), "after": F.lead("fp").over(beside)}).where("before is not null or after is not null")
    chained = met.select("fp", (F.shiftright("key", 44) % 3).alias("start")).distinct()

    def near(i: int) -> Column:
        return F.array(fp, *(fp.bitwiseXOR(F.lit(_flag(b))) for j in (i + 1, i + 2) for b in _bits(j)))

    start = F.col("start")
    points = chained.select("fp", F.explode(F.when(start == 0, near(0)).when(start == 1, near(1)).otherwise(near(2))).alias("at")).distinct()
    shared = points.groupBy("at").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return shared.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u <> v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null, empty and all-space texts have fingerprint zero and are linked like any
    other.  A null doc_id keeps its row and never names a component unless no
    member has an id.  Repeated rows and ids come out as often as they came in;
    empty tables give no rows; other columns are not read.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    fps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(fps.select("fp")))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
