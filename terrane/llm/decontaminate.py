"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages (48 words, every 24).  A passage is a
TF-IDF vector over the benchmark's terms: the root of a term's count times its
inverse document frequency over all documents; words outside the benchmark only add
to its length, by their own document frequency in a hashed table.  Words that share a
bucket count as more common than they are, which shortens a passage and can only make
it a candidate sooner.  A randomised SVD, computed in passes over distributed rows, maps
passages and items to a latent space in which cosines name the candidates.  A passage
whose exact cosine with an item is as high is a candidate too, so what a basis of few
dimensions leaves out of an item loses nothing.  A longest-common-subsequence check
on words and a check of the item's answer decide.

The document frequencies, the SVD's basis and the search cover every passage of every
document, repeated rows as often as they are there.  One pass sums the products of each
two terms over all passages; the SVD multiplies this matrix, whose size depends on the
block's terms alone.  (With the option ``sample`` the basis is fitted on about so many
passages, drawn by a hash of id and text, repeated rows once.)  A benchmark is read in
blocks of at most ``block`` items and ``BLOCK_TERMS`` terms (one item may have more), so
what is broadcast stays bounded.  The documents are read once for the frequencies of all
terms and twice, for the products and the search, for every ``PASS_BLOCKS`` blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard
from .text import Words, slices, sums

PASSAGE = 48
STRIDE = 24
RANK = 192
OVERSAMPLE = 16
POWER_ROUNDS = 2
BLOCK = 2_000
#: Distinct terms of a block, and blocks that are searched in one pass over the documents.
BLOCK_TERMS = 24_000
PASS_BLOCKS = 4
#: Terms whose document frequencies are counted in one pass.
COUNTED_TERMS = 1 << 22
#: Entries that are multiplied at once while the basis is fitted; results that a task holds before it sends them.
ENTRIES = 1 << 16
#: Of the products of two terms: commonest terms that are multiplied as a dense table, cells of the next ones' table,
#: products that are made at once, sums of rarer pairs that a task holds, cells of a shard of the matrix.
GRAM_DENSE = 256
GRAM_CELLS = 1 << 20
GRAM_PAIRS = 1 << 17
GRAM_HELD = 1 << 20
SHARD_CELLS = 1 << 18
HELD_ROWS = 4096
#: Buckets of the document frequencies of words outside the benchmark.
BUCKETS = 1 << 20
#: A document is drawn if its hash, one of so many values, is low enough.
DRAWS = 1 << 40
#: Latent or exact cosine from which a passage is a candidate.
COSINE = 0.20
#: Products of a passage's and an item's term that are held at once.
PAIRS = 1 << 20
#: At most so many terms (of the items: of at least so many items each) are multiplied as a dense table.
DENSE_TERMS = 512
DENSE_ITEMS = 4
#: Share of an item's words, in order: enough by itself, or with the answer.
LCS_ALONE = 0.75
LCS_WITH_ANSWER = 0.55


@dataclass
class Item:
    item_id: int
    words: np.ndarray  # hashes, in order
    answer: np.ndarray


_ANSWER = re.compile(r".*(?:\banswers?\s*:|\?)(.*\S.*)", re.S | re.I)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.string()), plain=True)
    h = w.hashes()
    return [h[a:b] for a, b in zip(w.off, w.off[1:], strict=False)]


def read_items(rows: list[tuple[int, str | None]]) -> list[Item]:
    """Items with at least one word.  The answer is what follows the last question mark or ``answer:``, else the last fifth (three words at least)."""
    out = []
    texts = [t or "" for _, t in rows]
    answers = [m[1] if (m := _ANSWER.match(t)) else "" for t in texts]
    for (item_id, _), words, answer in zip(rows, _hashes(texts), _hashes(answers), strict=True):
        if len(words):
            out.append(Item(item_id, words, answer if len(answer) else words[-max(3, len(words) // 5) :]))
    return out


def passages_of(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of the passages; a text with words has at least one."""
    n = w.n_words
    count = np.where(n > 0, np.maximum(-(-(n - (PASSAGE - STRIDE)) // STRIDE), 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = w.off[:-1][doc] + k * STRIDE
    return doc, first, np.minimum(first + PASSAGE, w.off[1:][doc])


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if hit := row & places.get(x, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def document_frequency(docs: DataFrame, terms: np.ndarray, buckets: bool = True) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(documents with each term, documents with a word of each bucket, documents, passages) over all rows of (doc_id, text); summed by term before it reaches the driver.

    The second is zero unless ``buckets``.
    """
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pd.Index(held.value)
        n = len(index)
        df = np.zeros(n + 2 + BUCKETS * buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), plain=True)
                hashes, doc = w.hashes(), w.doc
                at = index.get_indexer(hashes)
                pair = (doc * n + at)[at >= 0]
                df[:n] += np.bincount(pd.unique(pair) % max(n, 1), minlength=n)
                df[n] += w.n_docs
                df[n + 1] += len(passages_of(w)[0])
                if buckets:
                    np.add.at(df, n + 2 + pd.unique(doc * BUCKETS + _bucket(hashes)) % BUCKETS, 1)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "n"])

    n = len(terms)
    out = np.zeros(n + 2 + BUCKETS, np.int64)
    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out[:n], out[n + 2 :], int(out[n]), int(out[n + 1])


def _idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.maximum(np.log((n_docs + 1) / (df + 0.5)), 0.05)


def _vectors(at: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, root of the count) of the known terms in the ranges of ``off`` (pairs first, end), ordered by row."""
    size = off[1] - off[0]
    row = np.repeat(np.arange(len(size)), size)
    term = at[np.repeat(off[0] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    known = term >= 0
    width = int(at.max(initial=0)) + 1
    key, count = np.unique(row[known] * width + term[known], return_counts=True)
    return key // width, key % width, np.sqrt(count)


def _project(row: np.ndarray, term: np.ndarray, value: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """(n, dimensions) products of the rows with the basis; the terms of most rows as a dense table, the others one by one."""
    top = np.argsort(-np.bincount(term, minlength=len(basis)), kind="stable")[:DENSE_TERMS]
    column = np.full(len(basis), -1)
    column[top] = np.arange(len(top))
    column = column[term]
    held = column >= 0
    common = np.zeros((n, len(top)), np.float32)
    common[row[held], column[held]] = value[held]
    out = common @ basis[top]
    row, term, value = row[~held], term[~held], value[~held]
    if len(row):
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[heads]] += np.add.reduceat(basis[term] * value[:, None].astype(np.float32), heads, axis=0)
    return out


class Items:
    """The items' vectors by term: a dense table of the terms that many items have, postings of the others."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, n_items: int):
        self.n = n_items
        often = np.bincount(term, minlength=n_terms)
        top = np.argsort(-often, kind="stable")[:DENSE_TERMS]
        top = top[often[top] >= DENSE_ITEMS]
        #: column of a term in the dense table, else -1
        self.column = np.full(n_terms, -1)
        self.column[top] = np.arange(len(top))
        self.table = np.zeros((len(top), n_items), np.float32)
        held = self.column[term] >= 0
        self.table[self.column[term[held]], row[held]] = value[held]
        row, term, value = row[~held], term[~held], value[~held]
        order = np.argsort(term, kind="stable")
        self.off, self.item, self.value = np.searchsorted(term[order], np.arange(n_terms + 1)), row[order], value[order]

    @classmethod
    def of(cls, state: dict) -> Items:
        made = cls.__new__(cls)
        made.__dict__ |= state
        return made

    def products(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """(n, items) exact scalar products with the rows."""
        column = self.column[term]
        held = column >= 0
        common = np.zeros((n, len(self.table)), np.float32)
        common[row[held], column[held]] = value[held]
        out = common @ self.table
        row, term, value = row[~held], term[~held], value[~held]
        size = self.off[term + 1] - self.off[term]
        some = np.flatnonzero(size)
        row, term, value, size = row[some], term[some], value[some], size[some]
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1).tolist(), len(row)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                # rows are in order, so a part touches only a stretch of the result
                low, high, own = row[a], row[b - 1] + 1, size[a:b]
                at = np.repeat(self.off[term[a:b]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
                place = np.repeat((row[a:b] - low) * self.n, own) + self.item[at]
                out[low:high] += np.bincount(place, np.repeat(value[a:b], own) * self.value[at], (high - low) * self.n).reshape(-1, self.n)
        return out


def _gram(row: np.ndarray, term: np.ndarray, value: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """The transposed rows times the rows times the basis."""
    y = _project(row, term, value, basis, n)
    out = np.zeros(basis.shape)
    order = np.argsort(term, kind="stable")
    for a in range(0, len(order), ENTRIES):
        at = order[a : a + ENTRIES]
        heads = np.flatnonzero(np.diff(term[at], prepend=-1))
        out[term[at[heads]]] += np.add.reduceat(y[row[at]] * value[at, None].astype(np.float32), heads, axis=0)
    return out


class _Pairs:
    """Sums over rows of the products of each two terms, the commoner term first (terms are numbered by falling frequency).

    Pairs of the commonest terms are a matrix product, those of the next ones with any
    term lie in a table, the others are summed by sorted keys.
    """

    def __init__(self, n_terms: int, cells: int):
        self.n = n_terms
        self.common = np.zeros((min(GRAM_DENSE, n_terms),) * 2)
        self.table = np.zeros(min(n_terms, cells // n_terms) * n_terms)
        self.rest: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int) -> None:
        """Entries ordered by row and term."""
        size = len(self.common)
        inside = term < size
        common = np.zeros((n, size), np.float32)
        common[row[inside], term[inside]] = value[inside]
        self.common += common.T @ common
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        first = np.repeat(heads, np.diff(heads, append=len(row)))
        # a rarer term with itself and every commoner one of its row
        own = np.flatnonzero(~inside)
        size = own - first[own] + 1
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // GRAM_PAIRS)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                own_size = size[a:b]
                left = np.repeat(first[own[a:b]] - (np.cumsum(own_size) - own_size), own_size) + np.arange(own_size.sum())
                key = term[left] * self.n + np.repeat(term[own[a:b]], own_size)
                product = value[left] * np.repeat(value[own[a:b]], own_size)
                held = key < len(self.table)
                np.add.at(self.table, key[held], product[held])
                if not held.all():
                    self.rest.append((key[~held], product[~held]))
                    self.held += len(self.rest[-1][0])
                if self.held > GRAM_HELD:
                    self._merge()

    def _merge(self) -> None:
        key, product = (np.concatenate(x) for x in zip(*self.rest, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        self.rest = [(key[heads], np.add.reduceat(product[order], heads) if len(heads) else product)]
        self.held = len(heads)

    def full(self) -> bool:
        """Whether the rarer pairs should be sent, as few of them repeat."""
        return self.held > GRAM_HELD // 2

    def take(self, last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(commoner term * terms + rarer term, sum) of the rarer pairs, which are forgotten, and at last of all others."""
        if self.held:
            self._merge()
            yield self.rest[0]
            self.rest, self.held = [], 0
        if last:
            a, b = np.nonzero(np.triu(self.common))
            yield a * self.n + b, self.common[a, b]
            some = np.flatnonzero(self.table)
            yield some, self.table[some]


def _shards(n_terms: int) -> int:
    """Shards of the matrix of products; the row of term i is in shard i % shards, at i // shards."""
    return -(-n_terms // max(1, SHARD_CELLS // n_terms))


_SHARD = "block int, shard int, cell binary, value binary"


def _shard_rows(block: int, shard: np.ndarray, cell: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(shard, kind="stable")
    shard, cell, value = shard[order], cell[order].astype("<i4"), value[order].astype("<f4")
    heads = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, b in zip(heads, np.append(heads, len(shard))[1:], strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard[a]], pa.int32()), pa.array([cell[a:b].tobytes()], pa.binary()), pa.array([value[a:b].tobytes()], pa.binary())], names=["block", "shard", "cell", "value"])


def term_products(docs: DataFrame, blocks: list[tuple[np.ndarray, np.ndarray]], others: np.ndarray) -> DataFrame:
    """Shards (see _SHARD) of the upper half of each block's matrix: products of each two terms, summed over all passages of (doc_id, text), in one pass.

    A block is its terms, numbered by falling frequency, and their weights.
    """
    held = docs.sparkSession.sparkContext.broadcast((blocks, others))
    sizes = [len(terms) for terms, _ in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, others = held.value
        known = [(pd.Index(terms), idf, _Pairs(len(terms), GRAM_CELLS // len(told))) for terms, idf in told]

        def send(block: int, pairs: _Pairs, last: bool) -> Iterator[pa.RecordBatch]:
            for key, value in pairs.take(last):
                first, second = np.divmod(key, pairs.n)
                shards = _shards(pairs.n)
                yield from _shard_rows(block, first % shards, first // shards * pairs.n + second, value)

        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), plain=True)
                h = w.hashes()
                _, first, end = passages_of(w)
                outside = others[_bucket(h)]
                for block, (index, idf, pairs) in enumerate(known):
                    at = index.get_indexer(h)
                    energy = np.concatenate([[0], np.cumsum(np.where(at >= 0, idf[at], outside) ** 2)])
                    for k in range(0, len(first), 1024):
                        own = np.stack([first[k : k + 1024], end[k : k + 1024]])
                        row, term, value = _vectors(at, own)
                        pairs.add(row, term, value * idf[term] / np.sqrt(energy[own[1]] - energy[own[0]])[row], len(own[0]))
                        if pairs.full():
                            yield from send(block, pairs, False)
        for block, (_, _, pairs) in enumerate(known):
            yield from send(block, pairs, True)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, shard, cell, value in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (block, shard) not in sums:
                    sums[block, shard] = np.zeros(-(-sizes[block] // _shards(sizes[block])) * sizes[block])
                # no cell twice in a row
                sums[block, shard][np.frombuffer(cell, "<i4")] += np.frombuffer(value, "<f4")
        for (block, shard), cells in sums.items():
            some = np.flatnonzero(cells)
            yield from _shard_rows(block, np.full(len(some), shard), some, cells[some])

    parts = min(sum(map(_shards, sizes)), 256)
    return docs.select("text").mapInArrow(run, _SHARD).repartition(parts, "block", "shard").mapInArrow(total, _SHARD)


def fit_basis(shards: DataFrame, known: tuple[np.ndarray, np.ndarray, np.ndarray, int], n_terms: int, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """(terms, rank) right singular vectors, by randomised range finding, of the passages behind the shards of one block and of ``known`` (row, term, value, rows) together.

    Every round multiplies the shards by a thin matrix and sums per-partition products
    of ``n_terms`` by ``rank + OVERSAMPLE`` of at most four tasks; only these reach the driver.
    """
    width = min(rank + OVERSAMPLE, n_terms)
    spark = shards.sparkSession
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0].astype(np.float32)
    step = _shards(n_terms)

    def product(basis: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(basis)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            basis = held.value
            total = np.zeros(basis.shape)
            for batch in batches:
                for shard, cell, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    own = np.arange(shard, n_terms, step)
                    upper = np.zeros((len(own), n_terms), np.float32)
                    upper.ravel()[np.frombuffer(cell, "<i4")] = np.frombuffer(value, "<f4")
                    total[own] += upper @ basis
                    upper[np.arange(len(own)), own] = 0
                    total += upper.T @ basis[own]
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["z"])

        sent = shards.select("shard", "cell", "value").coalesce(4).mapInArrow(run, "z binary").collect()
        return sum((np.frombuffer(r["z"], "<f4").reshape(basis.shape) for r in sent), _gram(*known[:3], basis, known[3]))

    for _ in range(POWER_ROUNDS):
        basis = np.linalg.qr(product(basis))[0].astype(np.float32)
    # Rayleigh-Ritz: rotate the range to the singular directions and keep the largest
    small = basis.T @ product(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (basis @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)


SCHEMA = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_found boolean, contaminated boolean"


@dataclass
class _Corpus:
    """What is known of all documents: frequencies of the benchmark's terms and of buckets of other words, sizes, texts for the basis (all, or drawn ones)."""

    terms: np.ndarray
    df: np.ndarray
    others: np.ndarray
    n_docs: int
    n_passages: int
    drawn: DataFrame
    share: float


def _read(docs: DataFrame, terms: np.ndarray, sample: int | None = None) -> _Corpus:
    df, others = [], None
    for k in range(0, max(len(terms), 1), COUNTED_TERMS):
        own, counted, n_docs, n_passages = document_frequency(docs, terms[k : k + COUNTED_TERMS], others is None)
        df.append(own)
        others = counted if others is None else others
    if sample is None:
        return _Corpus(terms, np.concatenate(df), others, n_docs, n_passages, docs.select("text"), 1.0)
    share = min(1.0, sample / max(n_passages, 1))
    draw = F.xxhash64("doc_id", "text", F.lit(29))
    drawn = docs.select(draw.alias("draw"), "text").where(F.pmod("draw", F.lit(DRAWS)) < int(share * DRAWS))
    return _Corpus(terms, np.concatenate(df), others, n_docs, n_passages, cut(drawn.groupBy("draw").agg(F.first("text").alias("text")).select("text")), share)


@dataclass
class _Block:
    """A block of items, ready to be searched for."""

    terms: np.ndarray
    idf: np.ndarray
    basis: np.ndarray
    queries: np.ndarray
    exact: Items
    items: list[Item]


def _prepare(corpus: _Corpus, others: np.ndarray, told: list[list[Item]], rank: int) -> list[_Block]:
    """The latent spaces of some blocks' items among the passages, in one pass over the documents."""
    weighed = []
    for items in told:
        terms = np.unique(np.concatenate([x.words for x in items]))
        df = corpus.df[np.searchsorted(corpus.terms, terms)]
        order = np.argsort(-df, kind="stable")
        weighed.append((terms[order], _idf(df[order], corpus.n_docs)))
    products = cut(term_products(corpus.drawn, weighed, others).repartition(4))
    out = []
    for k, (items, (terms, idf)) in enumerate(zip(told, weighed, strict=True)):
        size = np.array([len(x.words) for x in items])
        off = np.concatenate([[0], np.cumsum(size)])
        row, term, value = _vectors(pd.Index(terms).get_indexer(np.concatenate([x.words for x in items])), np.stack([off[:-1], off[1:]]))
        value = value * idf[term]
        value /= np.sqrt(np.bincount(row, value**2, len(items)))[row]
        # the items weigh as much as all passages together
        weight = float(np.sqrt(max(1.0, corpus.share * corpus.n_passages / len(items))))
        basis = fit_basis(products.where(F.col("block") == k), (row, term, weight * value, len(items)), len(terms), rank)
        queries = _project(row, term, value, basis, len(items))
        queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
        out.append(_Block(terms, idf, basis, queries, Items(row, term, value, len(terms), len(items)), items))
    discard(products)
    return out


def _search(docs: DataFrame, blocks: list[_Block], others: np.ndarray, cosine: float) -> DataFrame:
    """The checked candidates of some blocks, in one pass over the documents."""
    held = docs.sparkSession.sparkContext.broadcast(([(x.terms, x.idf, x.basis, x.queries, vars(x.exact), [(i.item_id, i.words, i.answer) for i in x.items]) for x in blocks], others))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]

    def send(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, others = held.value
        blocks = [(pd.Index(terms), idf, basis, queries, Items.of(exact), [Item(*x) for x in items]) for terms, idf, basis, queries, exact, items in told]
        out: list[tuple] = []
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), plain=True)
                h = w.hashes()
                outside = others[_bucket(h)]
                for index, idf, basis, queries, exact, items in blocks:
                    for doc, item, best, start, end in _candidates(w, index.get_indexer(h), idf, outside, basis, queries, exact, cosine):
                        own = items[item]
                        reach = len(own.words)
                        region = h[max(start - reach, w.off[doc]) : min(end + reach, w.off[doc + 1])]
                        ratio = lcs(own.words, region) / len(own.words)
                        answered = lcs(own.answer, region) >= 0.6 * len(own.answer)
                        out.append((part.column("doc_id")[int(doc)].as_py(), own.item_id, float(best), ratio, answered, ratio >= LCS_ALONE or ratio >= LCS_WITH_ANSWER and answered))
                        if len(out) >= HELD_ROWS:
                            yield send(out)
                            out = []
        yield send(out)

    return docs.mapInArrow(run, SCHEMA)


def _candidates(w: Words, at: np.ndarray, idf: np.ndarray, outside: np.ndarray, basis: np.ndarray, queries: np.ndarray, exact: Items, cosine: float) -> Iterator[tuple]:
    """(text, item, best cosine, first word, end word) of neighbouring passages whose latent or exact cosine with an item is high enough.

    By Cauchy and Schwarz a cosine is at most the root of the share of a passage's
    squared length that lies in benchmark terms, so passages below are not projected.
    """
    doc, first, end = passages_of(w)
    if not len(doc):
        return
    squares = np.where(at >= 0, idf[at] ** 2, 0.0)
    known = sums(squares, np.array([0, len(squares)]))[0]
    if not known:
        return
    in_terms = np.concatenate([[0], np.cumsum(squares)])
    total = np.concatenate([[0], np.cumsum(np.where(at >= 0, squares, outside.astype(float) ** 2))])
    inside, length = in_terms[end] - in_terms[first], total[end] - total[first]
    live = np.flatnonzero(inside >= cosine**2 * length * (1 - 1e-9))
    for cut_at in range(0, len(live), 4096):
        some = live[cut_at : cut_at + 4096]
        row, term, value = _vectors(at, np.stack([first[some], end[some]]))
        value = value * idf[term]
        latent = _project(row, term, value, basis, len(some)) @ queries.T
        near = np.maximum(latent, exact.products(row, term, value, len(some))) / np.sqrt(length[some])[:, None]
        a, item = np.nonzero(near >= cosine)
        found = pd.DataFrame({"doc": doc[some[a]], "item": item, "near": near[a, item], "first": first[some[a]], "end": end[some[a]]})
        if len(found):
            # passages that overlap are checked together, ones that lie apart by themselves
            found = found.sort_values(["doc", "item", "first"], kind="stable")
            apart = (found["first"] >= found.groupby(["doc", "item"])["end"].shift(fill_value=-1)).cumsum()
            for _, g in found.groupby(apart.to_numpy()):
                yield int(g["doc"].iloc[0]), int(g["item"].iloc[0]), float(g["near"].max()), int(g["first"].min()), int(g["end"].max())


def _blocks(items: DataFrame, block: int) -> Iterator[list[Item]]:
    """Items in the order of their ids, in blocks of bounded items and terms."""
    own: list[Item] = []
    terms: set[int] = set()
    for r in items.toLocalIterator():
        for item in read_items([(r["item_id"], r["text"])]):
            words = set(item.words.tolist())
            if own and (len(own) >= block or len(terms | words) > BLOCK_TERMS):
                yield own
                own, terms = [], set()
            own.append(item)
            terms |= words
    if own:
        yield own


def candidates(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank: int = RANK, sample: int | None = None, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Checked candidates (see SCHEMA), one row per stretch of a document near an item (item_id, text).

    Null and empty documents and items match nothing; an empty benchmark or table
    gives no rows.  Repeated rows give repeated rows, a null id stays null, extra
    columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text")
    terms = np.zeros(0, np.uint64)
    for own in _blocks(items, block):
        terms = np.union1d(terms, np.concatenate([x.words for x in own]))
    if not len(terms):
        return spark.createDataFrame([], SCHEMA)
    corpus = _read(docs, terms, sample)
    others = _idf(corpus.others, corpus.n_docs).astype(np.float32)
    found = None
    for told in batched(_blocks(items, block), PASS_BLOCKS):
        part = _search(docs, _prepare(corpus, others, list(told), rank), others, cosine)
        found = part if found is None else found.union(part)
    if sample is not None:
        discard(corpus.drawn)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_ratio, answer_found) of each document and item that it contains, the best stretch of each."""
    found = candidates(docs, benchmark, **options).where("contaminated")
    best = F.max(F.struct("lcs_ratio", "cosine", "answer_found"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.cosine", "b.lcs_ratio", "b.answer_found")
