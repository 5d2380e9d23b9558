"""Language identification as mixture inference.

Each language is a smoothed distribution over hashed four-byte windows of words.
A document's words are drawn from a mixture of languages: expectation-maximisation
over the words' likelihoods estimates its proportions, and of the nested sets of its
likeliest languages the one with the best penalised likelihood (log-likelihood less
``penalty`` * log(words) for each language beyond the first) is kept and refitted.
The sets grow by every language that has a proportion of at least one word.  The
prediction is the largest proportion of the chosen set.

The language models are fitted on a bounded sample: at most about ``per_language``
training documents of each language (default 2,000), drawn evenly by a hash of id and
text, repeated rows once; with ``per_language=None``, as the pipeline has it, on all of
them, repeated rows each time.  Every document is then scored whole.  The table that goes to
every task has at most ``CELLS`` entries: with more than 512 languages its windows are
hashed to fewer bits.  Texts are read in slices that shrink as languages grow, so a task
holds at most some SLICE_BYTES * SLICE_LANGUAGES entries, or one text's words by language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import no_clash
from .text import _LOWER, _SPACE, SLICE_BYTES, Words, slices

PER_LANGUAGE = 2000
HASH_BITS = 17
ROUNDS = 8
PENALTY = 2.0
#: Entries of the table that is sent to every task (four bytes each).
CELLS = 1 << 26
#: Entries of the table that are looked up at once.
GATHERED = 1 << 22
#: With more languages than this, a slice of texts is so much smaller.
SLICE_LANGUAGES = 8
#: A document is drawn if its hash, one of so many values, is low enough.
DRAWS = 1 << 40
UNDETERMINED = "und"

_FLAT = np.where(_SPACE, np.uint8(0x20), _LOWER)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Model:
    langs: list[str]
    table: np.ndarray  # float32 (2 ** bits, languages): log probabilities
    bits: int


def _windows(texts: pa.Array, bits: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words with a letter and the hashed windows that belong to them: (words, first window, end of windows, hashes)."""
    w = Words(texts)
    flat = _FLAT[w.data]
    letters = np.concatenate([[0], np.cumsum(_LETTER[flat], dtype=np.int64)])
    keep = np.flatnonzero(letters[w.ends] > letters[w.starts])
    w.starts, w.ends = w.starts[keep], w.ends[keep]
    w.off = np.append(np.searchsorted(w.starts, w.doc_start), len(w.starts))
    raw = np.ndarray((len(flat) - 3,), "<u4", buffer=flat.tobytes(), strides=(1,))
    hashed = (np.ascontiguousarray(raw) * np.uint32(2654435761)) >> np.uint32(32 - bits)
    return w, w.starts - 1, np.maximum(w.ends - 2, w.starts), hashed


def _counts(texts: pa.Array, bits: int) -> np.ndarray:
    _, first, end, hashed = _windows(texts, bits)
    inside = np.zeros(len(hashed) + 1, np.int8)
    inside[first] = 1
    inside[end] -= 1
    return np.bincount(hashed[np.cumsum(inside[:-1], dtype=np.int8) > 0], minlength=1 << bits)


def _bits(bits: int, languages: int) -> int:
    """The hash bits that keep a table of so many languages within CELLS."""
    return max(1, min(bits, (CELLS // max(languages, 1)).bit_length() - 1))


def _drawn(rows: DataFrame, sizes: dict[str, int], per_language: int) -> DataFrame:
    """About so many rows of each language, repeated ones once."""
    limits = rows.sparkSession.createDataFrame([(x, min(DRAWS, DRAWS * per_language // sizes[x] + 1)) for x in sorted(sizes)], "lang string, share long")
    drawn = rows.join(F.broadcast(limits), "lang").where(F.pmod("draw", F.lit(DRAWS)) < F.col("share"))
    return drawn.groupBy("lang", "draw").agg(F.first("text").alias("text"))


def fit(labelled: DataFrame, per_language: int | None = PER_LANGUAGE, bits: int = HASH_BITS, smoothing: float = 0.5) -> Model:
    """Learn from rows (doc_id long, text, lang); rows with a null text, language or id teach nothing, repeated rows teach once (each time if ``per_language`` is None)."""
    rows = labelled.where("text is not null and lang is not null and doc_id is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text", F.lit(17)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    bits = _bits(bits, len(langs))
    if not langs:
        return Model([], np.zeros((1 << bits, 0), np.float32), bits)
    sample = rows if per_language is None else _drawn(rows, sizes, per_language)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("lang").to_pylist()
            for lang in sorted(set(of)):
                own = batch.filter(pa.array([x == lang for x in of]))
                for part in slices(own, "text"):
                    n = _counts(part.column("text"), bits)
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some].astype(np.int64))], names=["lang", "window", "n"])

    table = np.full((1 << bits, len(langs)), smoothing)
    # summed before it reaches the driver, which gets no more rows than the table has cells
    counts = sample.select("lang", "text").mapInArrow(run, "lang string, window long, n long").groupBy("lang", "window").agg(F.sum("n").alias("n")).toArrow()
    column = pa.compute.index_in(counts["lang"], value_set=pa.array(langs)).to_numpy()
    table[counts["window"].to_numpy(), column] += counts["n"].to_numpy()
    return Model(langs, np.log(table / table.sum(0)).astype(np.float32), bits)


def _by_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums over each text's words (axis 0); every range must be non-empty."""
    return np.add.reduceat(values, off[:-1], axis=0, dtype=np.float64)


def _em(ll: np.ndarray, off: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each text over its allowed languages, and its log-likelihood, from the words' log-likelihoods.

    Every word is scaled by its best allowed language, so no likelihood vanishes.
    """
    n = np.diff(off)
    pi = allowed / allowed.sum(1, keepdims=True)
    if allowed.all():
        scale = ll.max(1)
        p = np.exp(ll - scale[:, None])
    else:
        open_to = np.repeat(allowed > 0, n, axis=0)
        scale = np.where(open_to, ll, -np.inf).max(1)
        p = np.where(open_to, np.exp(np.minimum(ll - scale[:, None], 0)), 0)
    for k in range(rounds + 1):
        joint = p * np.repeat(pi, n, axis=0)
        total = np.maximum(joint.sum(1), 1e-300)
        if k == rounds:
            return pi, _by_doc(np.log(total) + scale, off)
        joint /= total[:, None]
        pi = _by_doc(joint, off) / n[:, None]
    raise AssertionError


def _likelihoods(model: Model, first: np.ndarray, end: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Each word's log-likelihood by language, GATHERED entries of the table at a time."""
    size = len(model.langs)
    step = max(1, GATHERED // size)
    out = np.empty((len(first), size), np.float32)
    a = 0
    while a < len(first):
        low = first[a]
        b = int(np.searchsorted(end, low + step, side="right"))
        if b <= a:
            # a word longer than a step
            out[a] = sum(model.table[hashed[k : min(k + step, end[a])]].sum(0, dtype=np.float64) for k in range(low, end[a], step))
            a += 1
            continue
        cuts = np.empty(2 * (b - a), np.int64)
        cuts[0::2], cuts[1::2] = first[a:b] - low, end[a:b] - low
        # the last word ends with the block
        out[a:b] = np.add.reduceat(model.table[hashed[low : end[b - 1]]], cuts[:-1], axis=0)[::2]
        a = b
    return out


def infer(model: Model, texts: pa.Array, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(proportions over the chosen languages, words with a letter) of each text; without such words all proportions are 0."""
    w, first, end, hashed = _windows(texts, model.bits)
    size = len(model.langs)
    out = np.zeros((w.n_docs, size))
    n = w.n_words
    some = np.flatnonzero(n)
    if not size or not len(some):
        return out, n
    ll = _likelihoods(model, first, end, hashed)
    off = np.append(w.off[:-1][some], len(first))
    best, _ = _em(ll, off, np.ones((len(some), size)), rounds)
    single = _by_doc(ll, off)
    top = single.argmax(1)
    score = single[np.arange(len(some)), top]
    chosen = np.zeros((len(some), size))
    chosen[np.arange(len(some)), top] = 1
    rank = np.argsort(-best, axis=1, kind="stable")
    # a set may hold every language with a word's worth of the text
    reach = (best * n[some][:, None] >= 1).sum(1)
    for k in range(2, int(reach.max()) + 1):
        mixed = np.flatnonzero(reach >= k)
        rows = np.concatenate([np.arange(off[j], off[j + 1]) for j in mixed])
        cut = np.concatenate([[0], np.cumsum(np.diff(off)[mixed])])
        allowed = np.zeros((len(mixed), size))
        np.put_along_axis(allowed, rank[mixed, :k], 1, axis=1)
        pi, fit_ll = _em(ll[rows], cut, allowed, rounds)
        value = fit_ll - penalty * (k - 1) * np.log(np.maximum(np.diff(cut), 2))
        better = value > score[mixed]
        chosen[mixed[better]] = pi[better]
        score[mixed[better]] = value[better]
    out[some] = chosen
    return out, n


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default the id), lang_pred, score, languages and shares (the chosen set, largest first).

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  Equal proportions go to the first language by name.  Repeated rows
    give repeated rows; extra columns are ignored; a kept column may not be named like
    one that is added.
    """
    keep = [id_col] if keep is None else keep
    no_clash(keep, ["lang_pred", "score", "languages", "shares"])
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.table, model.bits))
    # a text that is kept anyway travels once
    source = text_col if text_col in keep else "__text"
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).cast("string").alias(source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        limit = SLICE_BYTES * SLICE_LANGUAGES // max(SLICE_LANGUAGES, len(model.langs))
        for batch in batches:
            for part in slices(batch, source, limit):
                texts = part.column(source)
                pi, _ = infer(model, texts)
                letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()])
                order = np.argsort(-pi, axis=1, kind="stable")
                pred, score, langs, shares = [], [], [], []
                for k in range(len(texts)):
                    chosen = [j for j in order[k] if pi[k, j] > 0] if letters[k] else []
                    pred.append(model.langs[chosen[0]] if chosen else UNDETERMINED)
                    score.append(min(1.0, float(pi[k, chosen[0]])) if chosen else 0.0)
                    langs.append([model.langs[j] for j in chosen])
                    shares.append([float(pi[k, j]) for j in chosen])
                more = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *more], names=[*keep, "lang_pred", "score", "languages", "shares"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, "lang_pred string, score double, languages array<string>, shares array<double>"]))


def held_out(mod: int, remainder: int, id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text falls on the remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == remainder, F.lit(False))
