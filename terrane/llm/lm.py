"""Language-model scoring by deleted interpolation.

The probability of a token is a mixture of the maximum-likelihood estimates of its
bigram and unigram and a uniform distribution over the vocabulary and one unknown
word.  The weights depend on the frequency bucket (powers of two) of the context and
are learned by expectation-maximisation on counts held out of the training part: a
tenth of its documents, which the estimates then leave out ("deleted").  The final
estimates use all training documents.

Counts are corpus-wide, yet no table of them is ever broadcast.  Documents are dealt
into groups of bounded size; a group asks for each distinct n-gram once, sends along its
own counts, and gets the corpus-wide counts back from the bucket that owns the n-gram's
hash.  A very frequent word or bigram is therefore one number per group, not one row per
occurrence.  N-grams are told apart by hashes: 64 bits in a group, 48 bits within a
bucket, whose number grows with the corpus; two that collide there count as one.

Up to DIRECT groups every group writes to every bucket.  Beyond, the exchange takes two
hops over the root of that number: supergroups merge what their groups ask of a range
of buckets and pass on one block per bucket, so ``n`` groups exchange about
``4 * n ** 1.5`` rows and not ``2 * n ** 2``.  A group, a supergroup's range and a bucket
each hold about one group's n-grams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard
from .text import Words, mix, sums

GROUP_BYTES = 10 << 20
TUNING_SHARE = 10  # one in so many training documents
EM_ROUNDS = 60
CELLS_PER_OCTAVE = 4
KEY_BYTES = 6  # of a key within its bucket's range
RANGE_BYTES = 7  # of a key within the range of buckets that the first hop goes to
#: Groups up to which the exchange takes one hop.
DIRECT = 256

_U = np.uint64
_END, _BEGIN = _U(0x5851F42D4C957F2C), _U(0x14057B7EF767814F)


class _Tokens:
    """Tokens of some texts (their words, then one end): the group's sorted distinct unigrams and bigrams, and which each token is."""

    def __init__(self, texts: pa.Array):
        w = Words(texts, lower=True)
        self.n = w.n_words + 1
        self.off = w.off + np.arange(w.n_docs + 1)
        self.first = self.off[:-1]
        token = np.empty(self.off[-1], _U)
        last = np.zeros(len(token), bool)
        last[self.off[1:] - 1] = True
        token[~last] = w.hashes()
        token[last] = _END
        del w
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first] = _BEGIN
        pair = mix(mix(np.full(len(token), 0xA5A5, _U), before), token)
        del before
        self.words, self.word = _distinct(token)
        del token
        self.pairs, self.pair = _distinct(pair)

    def counts(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the distinct words and pairs over the texts where ``docs`` is true."""
        inside = np.repeat(docs, self.n)
        return np.bincount(self.word[inside], minlength=len(self.words)), np.bincount(self.pair[inside], minlength=len(self.pairs))

    def context(self, word: np.ndarray, texts: int) -> np.ndarray:
        """The count of each token's context, given the counts of the tokens and the texts counted."""
        out = np.empty_like(word)
        out[1:] = word[:-1]
        out[self.first] = texts
        return out


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(values, return_inverse=True)
    return keys, at.astype(np.int32)


class _Buckets:
    """The hash range cut into equal buckets; a key is packed as its leading bytes within its bucket."""

    def __init__(self, n: int, width: int = KEY_BYTES):
        self.edges = np.array([(k << 64) // n for k in range(n)], _U)
        self.width = width
        self.shift = _U(max(0, ((1 << 64) // n).bit_length() - 8 * width))

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket's keys begin among the sorted keys, and their number at the end."""
        return np.append(np.searchsorted(keys, self.edges), len(keys))

    def pack(self, keys: np.ndarray, bucket: int) -> bytes:
        """Byte planes, the slowly changing ones first, which the shuffle's codec shortens well."""
        left = (keys - self.edges[bucket]) >> self.shift
        return left.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - self.width :].T.tobytes()

    def unpack(self, data: bytes, bucket: int) -> np.ndarray:
        planes = np.frombuffer(data, np.uint8).reshape(self.width, -1)
        out = np.zeros((planes.shape[1], 8), np.uint8)
        out[:, 8 - self.width :] = planes.T
        return (out.view(">u8").ravel().astype(_U) << self.shift) + self.edges[bucket]


def _small(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those from 255 on follow in full."""
    large = counts[counts >= 255].astype("<i8")
    return len(counts).to_bytes(8, "little") + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes()


def _full(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=8 + n)
    return out


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + the power of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    names = [x.split() for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(names)], names=[n for n, _ in names])


_ASKED = "b long, g long, words binary, word_counts binary, pairs binary, pair_counts binary"
_TOLD = "g long, b long, words binary, pairs binary, tuned_words binary, tuned_pairs binary"
_ANSWER = f"{_TOLD}, n_tokens long, n_words long, n_tuned long"


def _blocks(buckets: _Buckets, among: range, g: int, words: np.ndarray, word_counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray) -> pa.Table:
    """One row per bucket of ``among`` that owns some of the sorted keys."""
    at, to = buckets.bounds(words), buckets.bounds(pairs)
    rows = []
    for b in among:
        w, p = slice(at[b], at[b + 1]), slice(to[b], to[b + 1])
        if w.stop > w.start or p.stop > p.start:
            rows.append((b, g, buckets.pack(words[w], b), _small(word_counts[w]), buckets.pack(pairs[p], b), _small(pair_counts[p])))
    return _table(rows, _ASKED)


def _asked(grouped: DataFrame, n_buckets: int, width: int) -> DataFrame:
    """What each group asks of each bucket: its distinct n-grams, with its own training counts."""

    def ask(table: pa.Table) -> pa.Table:
        train = np.array(table.column("train").to_pylist(), bool)
        t = _Tokens(_chunk(table.combine_chunks(), "text"))
        words, pairs = t.counts(train)
        return _blocks(_Buckets(n_buckets, width), range(n_buckets), table.column("g")[0].as_py(), t.words, words, t.pairs, pairs)

    return grouped.groupBy("g").applyInArrow(ask, _ASKED)


class _Merged:
    """The blocks that a bucket or range was sent, by kind (word, pair): distinct keys, where each block's keys are among them, and their counts."""

    def __init__(self, table: pa.Table, kind: str, buckets: _Buckets):
        b = table.column("b")[0].as_py()
        parts = [buckets.unpack(x, b) for x in table.column(f"{kind}s").to_pylist()]
        self.size = np.array([len(x) for x in parts])
        self.off = np.concatenate([[0], np.cumsum(self.size)])
        self.keys, self.at = _distinct(np.concatenate(parts))
        self.sent = np.concatenate([_full(x) for x in table.column(f"{kind}_counts").to_pylist()])

    def total(self, of: np.ndarray | None = None) -> np.ndarray:
        """Summed counts of each key, of all blocks or those where ``of`` is true."""
        sent = self.sent if of is None else self.sent * np.repeat(of, self.size)
        return np.bincount(self.at, weights=sent, minlength=len(self.keys)).astype(np.int64)

    def block(self, k: int, values: np.ndarray) -> bytes:
        """The values of the keys of block ``k``, in the order asked."""
        return _small(values[self.at[self.off[k] : self.off[k + 1]]])


def _answered(asked: DataFrame, n_buckets: int, first_tuning: int) -> DataFrame:
    """Corpus-wide counts of what each group asked, in the order asked; tuning groups also get the tuning counts; g -1: the bucket's tokens, distinct words and tuning tokens."""

    def answer(table: pa.Table) -> pa.Table:
        gs = np.array(table.column("g").to_pylist())
        b, tuning = table.column("b")[0].as_py(), gs >= first_tuning
        word, pair = (_Merged(table, kind, _Buckets(n_buckets)) for kind in ("word", "pair"))
        words, pairs, tuned_words, tuned_pairs = word.total(), pair.total(), word.total(tuning), pair.total(tuning)
        rows = [(-1, b, b"", b"", b"", b"", int(words.sum()), int((words > 0).sum()), int(tuned_words.sum()))]
        for k, g in enumerate(gs.tolist()):
            tuned = (word.block(k, tuned_words), pair.block(k, tuned_pairs)) if tuning[k] else (b"", b"")
            rows.append((g, b, word.block(k, words), pair.block(k, pairs), *tuned, 0, 0, 0))
        return _table(rows, _ANSWER)

    return asked.groupBy("b").applyInArrow(answer, _ANSWER)


def _passed_on(asked: DataFrame, fan: int) -> DataFrame:
    """What supergroups ask of single buckets: the blocks (with ``s`` and ``at``, the supergroup and its range) of a range of buckets, merged."""

    def merge(table: pa.Table) -> pa.Table:
        b, s = table.column("b")[0].as_py(), table.column("s")[0].as_py()
        word, pair = (_Merged(table, kind, _Buckets(fan, RANGE_BYTES)) for kind in ("word", "pair"))
        return _blocks(_Buckets(fan * fan), range(b * fan, (b + 1) * fan), s, word.keys, word.total(), pair.keys, pair.total())

    return asked.groupBy("at").applyInArrow(merge, _ASKED)


def _handed_back(asked: DataFrame, told: DataFrame, fan: int) -> DataFrame:
    """The answers to supergroups, dealt to their groups in the order that these asked."""

    def spread(mine: pa.Table, replies: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return _table([], _TOLD)
        word, pair = (_Merged(mine, kind, _Buckets(fan, RANGE_BYTES)) for kind in ("word", "pair"))
        words, pairs, tuned_words, tuned_pairs = (_told(replies, x) for x in ("words", "pairs", "tuned_words", "tuned_pairs"))
        tuning = bool(len(tuned_words) or len(tuned_pairs))
        rows = []
        for k, (g, b) in enumerate(zip(mine.column("g").to_pylist(), mine.column("b").to_pylist(), strict=True)):
            tuned = (word.block(k, tuned_words), pair.block(k, tuned_pairs)) if tuning else (b"", b"")
            rows.append((g, b, word.block(k, words), pair.block(k, pairs), *tuned))
        return _table(rows, _TOLD)

    back = told.where("g >= 0").withColumn("at", F.col("g") * fan + F.floor(F.col("b") / fan))
    return asked.groupBy("at").cogroup(back.groupBy("at")).applyInArrow(spread, _TOLD)


def _exchange(rows: DataFrame, groups: int, direct: int) -> tuple[DataFrame, np.ndarray]:
    """(answers to every group, [tokens, distinct words, tuning tokens]) of rows (g, text, train); groups from ``groups`` on are tuning groups."""
    if groups <= direct:
        told = cut(_answered(_asked(rows, groups, KEY_BYTES), groups, groups))
        replies, done = told.where("g >= 0"), []
    else:
        fan = math.isqrt(groups - 1) + 1
        first_tuning = -(-groups // fan)
        asked = _asked(rows, fan, RANGE_BYTES)
        s = F.when(F.col("g") < groups, F.floor(F.col("g") / fan)).otherwise(first_tuning + F.floor((F.col("g") - groups) / fan))
        asked = cut(asked.withColumn("s", s).withColumn("at", F.col("s") * fan + F.col("b")))
        told = cut(_answered(_passed_on(asked, fan), fan * fan, first_tuning))
        replies, done = cut(_handed_back(asked, told, fan)), [asked, told]
    stats = np.array([x or 0 for x in told.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("n_tuned")).first()])
    for table in done:
        discard(table)
    return replies, stats


def _chunk(table: pa.Table, column: str) -> pa.Array:
    got = table.column(column)
    return got.chunk(0) if got.num_chunks == 1 else pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], pa.string())


def _told(replies: pa.Table, column: str) -> np.ndarray:
    """A group's counts, put together in the order of the buckets."""
    order = np.argsort(replies.column("b").to_numpy())
    parts = replies.column(column).to_pylist()
    return np.concatenate([_full(parts[k]) for k in order]) if len(order) else np.zeros(0, np.int64)


def _cells(docs: DataFrame, replies: DataFrame, n_fit: int, texts: int) -> DataFrame:
    """Held-out events by (context bucket, bigram estimate, unigram estimate), the estimates on a log grid, -1 for zero."""

    def grid(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * CELLS_PER_OCTAVE), -1).astype(np.int64)

    def count(mine: pa.Table, told: pa.Table) -> pa.Table:
        names = ["bucket", "bi", "uni", "n"]
        if not mine.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in names})
        t = _Tokens(_chunk(mine.combine_chunks(), "text"))
        word = (_told(told, "words") - _told(told, "tuned_words"))[t.word]
        pair = (_told(told, "pairs") - _told(told, "tuned_pairs"))[t.pair]
        context = t.context(word, texts)
        cell = np.stack([_bucket(context), grid(pair / np.maximum(context, 1)), grid(word / max(n_fit, 1))], 1)
        cells, n = np.unique(cell, axis=0, return_counts=True)
        return pa.table({k: pa.array(v.astype(np.int64)) for k, v in zip(names, [*cells.T, n], strict=True)})

    found = docs.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(count, "bucket long, bi long, uni long, n long")
    return found.groupBy("bucket", "bi", "uni").agg(F.sum("n").alias("n"))


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = EM_ROUNDS) -> np.ndarray:
    """(buckets, 3) weights of bigram, unigram and uniform by expectation-maximisation on rows (bucket, bi, uni, n) of grid cells.

    One pseudo-event per part keeps every weight positive; buckets without events
    get the pooled weights; an unseen context gives the bigram no weight.
    """

    def fit(rows: np.ndarray, seen: bool) -> np.ndarray:
        value = [np.where(rows[:, k] >= 0, 2.0 ** (-rows[:, k] / CELLS_PER_OCTAVE), 0.0) for k in (1, 2)]
        p = np.stack([*value, np.full(len(rows), uniform)], 1)
        weight = np.array([1.0, 1.0, 1.0]) / 3 if seen else np.array([0.0, 0.5, 0.5])
        prior = (weight > 0).astype(float)
        for _ in range(rounds):
            joint = p * weight
            share = joint / joint.sum(1, keepdims=True)
            weight = (share * rows[:, 3:]).sum(0) + prior
            weight /= weight.sum()
        return weight

    pooled = fit(cells[cells[:, 0] > 0], True)
    out = np.tile(pooled, (65, 1))
    out[0] = fit(cells[cells[:, 0] == 0], False)
    for k in range(1, 65):
        if len(own := cells[cells[:, 0] == k]):
            out[k] = fit(own, True)
    return out


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = GROUP_BYTES, direct: int = DIRECT) -> DataFrame:
    """One row per row of ``docs`` (see SCHEMA): counts and log10 probabilities of whole texts, learned where ``held_out`` is false.

    Null texts are empty and have one token, the end.  Repeated rows count as often
    as they occur and come out as often, and are dealt to several groups where one would
    not hold them; a null id stays null and is no held-out row; an empty table gives
    no rows; extra columns are not read.  With nothing to learn from every
    probability is that of the one unknown word.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (~held_out).alias("train"))
    sizes = rows.groupBy(F.xxhash64("doc_id", "text").alias("row")).agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"))
    size, repeated = sizes.agg(F.sum("bytes"), F.max(F.when(F.col("n") > 1, F.col("bytes")))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(parts, -(-(size or 0) // group_bytes))
    tuning = max(1, groups // TUNING_SHARE)
    # copies of a row are equal to any hash; where a group could not hold them they are numbered, once
    number = F.lit(0).cast("long")
    if (repeated or 0) > group_bytes:
        rows, number = cut(rows.withColumn("number", F.monotonically_increasing_id())), F.col("number")
    deal = F.xxhash64("doc_id", "text", number)
    rows = rows.withColumn("tune", F.col("train") & (F.pmod(F.xxhash64("doc_id", "text", number, F.lit(5)), F.lit(TUNING_SHARE)) == 0))
    rows = rows.withColumn("g", F.when(F.col("tune"), groups + F.pmod(deal, F.lit(tuning))).otherwise(F.pmod(deal, F.lit(groups))).cast("long"))

    n_train, n_tune = rows.agg(F.count_if("train"), F.count_if("tune")).first()
    replies, stats = _exchange(rows.select("g", "text", "train"), groups, direct)
    n, v, tuned = (int(x) for x in stats)
    cells = cut(_cells(rows.where("tune").select("g", "text"), replies.where(F.col("g") >= groups), n - tuned, n_train - n_tune)).collect()
    weights = learn_weights(np.array([tuple(r) for r in cells], np.int64).reshape(-1, 4), 1 / (v + 1))

    def rate(mine: pa.Table, told: pa.Table) -> pa.Table:
        mine = mine.combine_chunks()
        if not mine.num_rows:
            return pa.table({x.split()[0]: pa.array([], kind) for x, kind in zip(SCHEMA.split(", "), kinds, strict=True)})
        t = _Tokens(_chunk(mine, "text"))
        word, pair = _told(told, "words")[t.word], _told(told, "pairs")[t.pair]
        context = t.context(word, n_train)
        w = weights[_bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(n, 1) + w[:, 2] / (v + 1)
        base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
        train = np.array(mine.column("train").to_pylist(), bool)
        cols = [mine.column("doc_id"), pa.array(~train), pa.array(t.n), pa.array(sums((word > 0), t.off)), pa.array(np.full(len(train), n)), pa.array(_exact(base, t.off)), pa.array(_exact(np.log10(p), t.off))]
        return pa.table({x.split()[0]: c for x, c in zip(SCHEMA.split(", "), cols, strict=True)})

    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return rows.select("g", "doc_id", "text", "train").groupBy("g").cogroup(replies.select("g", "b", "words", "pairs").groupBy("g")).applyInArrow(rate, SCHEMA)


def _exact(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of each text's values by itself, so that they don't depend on its neighbours."""
    return np.add.reduceat(values, off[:-1])
