"""Quality rules on tokeniser fertility.

Public vocabularies measure each whole text word by word, every word with the blank
before it as in running text: characters per token, the share of byte-fallback tokens
and the entropy of its tokens.  A text is rejected if a measure leaves the band of its
script, or if its characters per byte-level token leave the band of its language, which
is read off all documents.  Words are encoded whole, however long, once per worker and
then looked up by hash, so the cost per word is a table lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .text import Words, mix, slices, sums

#: Words that a worker remembers before it starts over.
CACHE_WORDS = 400_000
#: Longer words are encoded each time and not remembered.
REMEMBERED_BYTES = 4096


@dataclass(frozen=True)
class Band:
    """Characters per token, byte-fallback share and token entropy (bits) that a text may have."""

    chars_low: float
    chars_high: float
    byte_share: float
    entropy_low: float


#: Bands by script.  Byte-level vocabularies spend more tokens on scripts that they
#: saw little of, hence the wider limits beyond Latin letters.  Prose of MIN_TOKENS
#: tokens has well over four bits of entropy; loops and single-symbol filler have less.
BANDS = {
    "latin": Band(1.3, 8.0, 0.20, 3.5),
    "cyrillic": Band(0.8, 8.0, 0.20, 3.5),
    "greek": Band(0.4, 8.0, 0.40, 3.5),
    "arabic": Band(0.4, 8.0, 0.50, 3.0),
    "hebrew": Band(0.4, 8.0, 0.50, 3.0),
    "han": Band(0.3, 4.0, 0.75, 3.0),
    "hangul": Band(0.3, 4.0, 0.75, 3.0),
    "other": Band(0.2, 8.0, 0.95, 2.5),
}
#: Texts of fewer tokens are too short to be judged by fertility.
MIN_TOKENS = 64

#: A language's band: so many quartile distances beyond the quartiles of its texts.
FENCE = 3.0
#: Least quartile distance, as a share of the median; copies of one text have none.
LEAST_SPREAD = 0.02
#: Languages with fewer texts to judge only have the band of their script.
MIN_TEXTS = 100

# Fixed values: (script, first, last code point) of blocks of letters.
_BLOCKS = (
    ("latin", 0x41, 0x5A), ("latin", 0x61, 0x7A), ("latin", 0xC0, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("other", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x6FF), ("other", 0x700, 0x74F), ("arabic", 0x750, 0x77F), ("other", 0x780, 0x89F), ("arabic", 0x8A0, 0x8FF), ("other", 0x900, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("other", 0x1200, 0x1C7F), ("cyrillic", 0x1C80, 0x1C8F), ("other", 0x1C90, 0x1CFF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("latin", 0x2C60, 0x2C7F), ("cyrillic", 0x2DE0, 0x2DFF),
    ("han", 0x2E80, 0x2FDF), ("han", 0x3005, 0x3007), ("han", 0x3040, 0x312F), ("hangul", 0x3130, 0x318F), ("han", 0x31A0, 0x9FFF), ("other", 0xA000, 0xA63F), ("cyrillic", 0xA640, 0xA69F),
    ("latin", 0xA720, 0xA7FF), ("other", 0xA800, 0xA95F), ("hangul", 0xA960, 0xA97F), ("other", 0xA980, 0xABFF), ("hangul", 0xAC00, 0xD7FF), ("han", 0xF900, 0xFAFF), ("hebrew", 0xFB1D, 0xFB4F),
    ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFE), ("latin", 0xFF21, 0xFF3A), ("latin", 0xFF41, 0xFF5A), ("han", 0x20000, 0x3FFFF),
)
_SCRIPTS = (*BANDS,)
_FIRST = np.array([a for _, a, _ in _BLOCKS])
_LAST = np.array([b for _, _, b in _BLOCKS])
_OF_BLOCK = np.array([_SCRIPTS.index(s) for s, _, _ in _BLOCKS])
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_CONT = np.zeros(256, bool)
_CONT[range(0x80, 0xC0)] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


class Fertility:
    """Tokens of words under a piece vocabulary with byte fallback and a byte-level vocabulary."""

    def __init__(self, pieces: bytes, ranks: bytes, pattern: str):
        import base64

        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(k) for k in range(self.size)])
        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
        self.bytes = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self._clear()

    def _clear(self) -> None:
        self.index = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.off = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.second = np.zeros(0, np.int64)

    def _encode(self, words: list[str]) -> tuple[list[list[int]], list[int]]:
        """Pieces of each word, and its number of byte-level tokens, both with a blank before the word."""
        return self.pieces.encode(words, num_threads=1), [len(self.bytes.encode_ordinary(f" {x}")) for x in words]

    def lookup(self, w: Words, hashes: np.ndarray) -> np.ndarray:
        """Slots of the distinct words (their hashes, and any place of each in w)."""
        keys, places = hashes
        if len(self.off) > CACHE_WORDS:
            self._clear()
        at = np.searchsorted(self.index, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.index)
        known[inside] = self.index[at[inside]] == keys[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            ids, second = self._encode([w.word(k).decode("utf-8", "replace") for k in places[new].tolist()])
            base = len(self.off) - 1
            self.off = np.concatenate([self.off, self.off[-1] + np.cumsum([len(x) for x in ids])])
            self.ids = np.concatenate([self.ids, np.array([t for x in ids for t in x], np.int32)])
            self.second = np.concatenate([self.second, second])
            index = np.concatenate([self.index, keys[new]])
            slot = np.concatenate([self.slot, base + np.arange(len(new))])
            order = np.argsort(index)
            index, slot = index[order], slot[order]
            found = slot[np.searchsorted(index, keys)]
            short = (w.ends - w.starts)[places[new]] <= REMEMBERED_BYTES
            kept = np.ones(len(index), bool) if short.all() else ~np.isin(index, keys[new][~short])
            self.index, self.slot = index[kept], slot[kept]
            return found
        return self.slot[at]


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for each k, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def scripts_of(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The script that most letters of each byte range (first, end) have; the first of BANDS among equals and without letters."""
    plain = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data], dtype=np.int64)])[bounds]
    counts = np.zeros((len(bounds), len(_SCRIPTS)), np.int64)
    counts[:, _SCRIPTS.index("latin")] = plain[:, 1] - plain[:, 0]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        b = data[at[:, None] + np.arange(4)].astype(np.int64)
        tail = b[:, 1:] & 0x3F
        code = np.where(b[:, 0] < 0xE0, (b[:, 0] & 0x1F) << 6 | tail[:, 0], np.where(b[:, 0] < 0xF0, (b[:, 0] & 0x0F) << 12 | tail[:, 0] << 6 | tail[:, 1], (b[:, 0] & 0x07) << 18 | tail[:, 0] << 12 | tail[:, 1] << 6 | tail[:, 2]))
        block = np.searchsorted(_FIRST, code, side="right") - 1
        letter = code <= _LAST[block]
        text = np.searchsorted(bounds[:, 0], at[letter], side="right") - 1
        np.add.at(counts, (text, _OF_BLOCK[block[letter]]), 1)
    return counts.argmax(1)


def measure(texts: pa.Array, fertility: Fertility) -> dict[str, np.ndarray]:
    """Counts and measures of each whole text; null counts as empty."""
    w = Words(texts)
    n, off = w.n_words, w.off
    bounds = np.stack([w.doc_start, w.doc_end], 1)
    chars = np.concatenate([[0], np.cumsum(~_CONT[w.data], dtype=np.int64)])
    word_chars = sums(chars[w.ends] - chars[w.starts], off)
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[w.data], dtype=np.int64)])
    n_symbols = symbol[bounds[:, 1]] - symbol[bounds[:, 0]]
    hashes = w.hashes()
    doc = w.doc

    dup = np.zeros(w.n_docs, np.int64)
    for k in range(w.n_docs):
        lines = w.bytes[w.doc_start[k] : w.doc_end[k]].split(b"\n")
        if len(lines) > 1:
            real = [x for x in lines if x and not x.translate(None, b" \t\v\f\r") == b""]
            dup[k] = len(real) - len(set(real))

    repeat = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        whole = doc[:-2] == doc[2:]
        window = mix(mix(mix(doc[:-2].astype(np.uint64), hashes[:-2]), hashes[1:-1]), hashes[2:])
        code, _ = pd.factorize(window)
        often = (np.bincount(code[whole], minlength=code.max() + 1)[code] > 1) & whole
        repeat[:-2] |= often
        repeat[1:-1] |= often
        repeat[2:] |= often

    code, keys = pd.factorize(hashes)
    places = np.zeros(len(keys), np.int64)
    places[code[::-1]] = np.arange(len(hashes))[::-1]
    slot = fertility.lookup(w, (keys, places))
    size = np.diff(fertility.off)[slot]
    tokens = size[code]
    n_tokens = sums(tokens, off)
    bytes_of = np.concatenate([[0], np.cumsum(fertility.is_byte[fertility.ids], dtype=np.int64)])
    n_bytes = sums((bytes_of[fertility.off[slot + 1]] - bytes_of[fertility.off[slot]])[code], off)
    second = sums(fertility.second[slot][code], off)
    all_ids = fertility.ids[_ranges(fertility.off[slot][code], tokens)].astype(np.int64)
    pair, seen = pd.factorize(np.repeat(doc, tokens) * fertility.size + all_ids)
    count = np.bincount(pair, minlength=len(seen)).astype(float)
    of = seen // fertility.size
    logs = np.bincount(of, weights=count * np.log2(count), minlength=w.n_docs) if len(seen) else np.zeros(w.n_docs)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = np.where(n_tokens > 0, np.log2(np.maximum(n_tokens, 1)) - logs / np.maximum(n_tokens, 1), 0.0)

    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": dup, "n_repeat_words": sums(repeat, off),
        "n_tokens": n_tokens, "chars_per_token": word_chars / np.maximum(n_tokens, 1), "chars_per_byte_token": word_chars / np.maximum(second, 1),
        "byte_share": n_bytes / np.maximum(n_tokens, 1), "entropy": entropy, "script": scripts_of(w.data, bounds),
    }


def verdict(m: dict[str, np.ndarray]) -> np.ndarray:
    """Whether each text keeps within its script's band; short texts are not judged."""
    low, high, share, entropy = (np.array([getattr(BANDS[s], f) for s in _SCRIPTS])[m["script"]] for f in ("chars_low", "chars_high", "byte_share", "entropy_low"))
    both = (m["chars_per_token"] >= low) & (m["chars_per_token"] <= high) & (m["chars_per_byte_token"] >= low / 2) & (m["chars_per_byte_token"] <= high)
    return (m["n_tokens"] < MIN_TOKENS) | (both & (m["byte_share"] <= share) & (m["entropy"] >= entropy))


def within(measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept`` taken from texts outside the band of their script and language."""
    judged = measured.where(~F.col("base_failed") & (F.col("n_tokens") >= MIN_TOKENS))
    quartiles = F.percentile_approx(F.round("chars_per_byte_token", 3), [0.25, 0.5, 0.75], 100_000)
    bands = judged.groupBy("script", F.coalesce("lang", F.lit("")).alias("of")).agg(quartiles.alias("q"), F.count("*").alias("n")).where(F.col("n") >= MIN_TEXTS)
    reach = FENCE * F.greatest(F.col("q")[2] - F.col("q")[0], LEAST_SPREAD * F.col("q")[1])
    bands = bands.select(F.col("script").alias("in_script"), "of", (F.col("q")[0] - reach).alias("low"), (F.col("q")[2] + reach).alias("high"))
    rated = measured.join(F.broadcast(bands), (F.col("script") == F.col("in_script")) & (F.coalesce("lang", F.lit("")) == F.col("of")), "left")
    inside = (F.col("n_tokens") < MIN_TOKENS) | F.coalesce(F.col("chars_per_byte_token").between(F.col("low"), F.col("high")), F.lit(True))
    return rated.withColumn("kept", F.col("kept") & inside)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, chars_per_byte_token double, byte_share double, entropy double, script string"


def rate(docs: DataFrame, pieces: bytes, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` with its counts, measures and verdict (see SCHEMA).

    Languages are those of a column ``lang``, if there is one, by script.  The bands come
    from every row that passes the base rule; the measures are written once for that.

    Null and empty texts have no words and fail the base rule.  Words of any length are
    encoded whole.  Repeated rows give repeated rows, a null id stays null, extra columns
    are not read, an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast((pieces, ranks, pattern))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")).alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(*held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(part.column("text"), fertility)
                failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
                cols = {"doc_id": part.column("doc_id"), **{k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, "base_failed": failed, "kept": ~failed & verdict(m)}
                cols |= {k: m[k] for k in ("n_tokens", "chars_per_token", "chars_per_byte_token", "byte_share", "entropy")} | {"script": pa.array([_SCRIPTS[k] for k in m["script"]], pa.string()), "lang": part.column("lang")}
                yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})

    return within(cut(rows.mapInArrow(run, f"{SCHEMA}, lang string"))).select(*(c.split()[0] for c in SCHEMA.split(", ")))
