"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled once into three machines: the normaliser (the model's longest-
match rewrite rules, runs of spaces, dummy prefix, spaces to the mark), the lexicon (a
trie of the pieces, with a byte-fallback arc for every character outside it) and the
weights.  Each input is composed with them and
the tropical-semiring shortest path is its encoding:

* unigram models: an arc costs its piece's negative score; fallback costs the
  dearest piece and ten more, a user's symbol less than anything; the path is found by
  the usual relaxation; neighbouring unknown characters are one unknown piece;
* BPE models: two adjacent pieces cost 0 if merging their characters by rank gives
  back exactly these two, else infinity.  A sequence all of whose neighbours agree is
  the merge result itself, so one path is finite and the search for it is linear.

Both machines cut the input where no piece goes over, and memoise the parts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import no_clash
from .text import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the file format
UNIGRAM, BPE = 1, 2  # model types of the file format
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PARTS_KEPT = 600_000
PAIRS_KEPT = 500_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def _rewrites(rules: bytes) -> dict[str, str]:
    """The rewrite rules of a model file: the size of a double-array trie, its 32-bit units, and the outputs, each ended by a zero."""
    if not rules:
        return {}
    size = int.from_bytes(rules[:4], "little")
    units = np.frombuffer(rules, "<u4", size // 4, 4).astype(np.int64)
    texts = rules[4 + size :]
    labels = np.arange(1, 256)

    def base(at: int) -> int:
        unit = int(units[at])
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    out, todo = {}, [(base(0), b"")]
    while todo:
        low, key = todo.pop()
        places = low ^ labels
        inside = places < len(units)
        places, bytes_ = places[inside], labels[inside]
        for place, byte in zip(places[units[places] & 0x800000FF == bytes_].tolist(), bytes_[units[places] & 0x800000FF == bytes_].tolist(), strict=True):
            below, longer = base(place), key + bytes([byte])
            if units[place] >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                out[longer.decode()] = texts[start : texts.index(b"\0", start)].decode()
            todo.append((below, longer))
    return out


class Transducer:
    """A compiled model; plain data only, so it travels to executors as it is."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.dummy_prefix, self.fallback, self.squeeze, rules = UNIGRAM, True, False, True, b""
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif field == 2:
                spec = dict(_fields(value))
                self.kind, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("marks behind words are not compiled")
            elif field == 3:
                spec = dict(_fields(value))
                rules, self.dummy_prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if not spec.get(5, 1):
                    raise ValueError("models that leave spaces as they are are not compiled")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {self.kind} has no transducer")
        self.unknown = self.types.index(UNKNOWN)
        #: rewrites by their first character, longest first; a user's symbol stays as it is
        self.rewrites: dict[str, list[tuple[str, str]]] = {}
        for old, new in (_rewrites(rules) | {p: p for p, t in zip(self.pieces, self.types, strict=True) if t == USER and rules}).items():
            self.rewrites.setdefault(old[0], []).append((old[1:], new))
        for found in self.rewrites.values():
            found.sort(key=lambda x: -len(x[0]))
        self.byte_ids = {int(p[3:5], 16): k for k, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        if self.fallback and len(self.byte_ids) != 256:
            raise ValueError("byte fallback needs all 256 byte pieces")
        lexicon = {p: k for k, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t in (NORMAL, USER, UNUSED) and p}
        if any(MARK in p.lstrip(MARK) for p in lexicon):
            raise ValueError("a piece goes over a word boundary")
        self.rank = {p: -self.scores[k] for p, k in lexicon.items()}
        self.split: dict[int, tuple[int, int] | None] = {}
        if self.kind == BPE:
            for piece, k in sorted(lexicon.items(), key=lambda x: len(x[0])):
                if len(piece) == 1:
                    self.split[k] = None
                elif (parts := self._last_merge(piece)) and all(x in lexicon and (len(x) == 1 or self.rank[x] <= self.rank[piece]) for x in parts):
                    self.split[k] = (lexicon[parts[0]], lexicon[parts[1]])
            lexicon = {p: k for p, k in lexicon.items() if k in self.split}
        self.trie: dict = {}
        for piece, k in lexicon.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = k
        costs = [-x for x, t in zip(self.scores, self.types, strict=True) if t == NORMAL]
        self.fallback_cost = max(costs, default=0.0) + 10
        self.costs = [-x if t != USER else 0.1 + len(p.encode()) * min(costs, default=0.0) for p, x, t in zip(self.pieces, self.scores, self.types, strict=True)]
        inside = {(a, b) for p in lexicon for a, b in zip(p, p[1:], strict=False)}
        used = {c for p in lexicon for c in p}
        letters = {c for c in map(chr, range(0x30, 0x250)) if c.isalnum()}
        #: control characters that no piece has, and signs that no piece puts behind a letter
        self.alone = [c for c in "\n\r\t" if c not in used or not any(c in pair for pair in inside)]
        self.after = [c for c in _SIGNS if c not in self.alone and not any((x, c) in inside for x in letters)]
        #: what a piece says in bytes; controls say nothing
        self.says = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode() for p, t in zip(self.pieces, self.types, strict=True)]
        self.parts: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self._cutter: re.Pattern | None = None
        self._starter: re.Pattern | None = None

    def normal(self, text: str) -> str:
        """The text after the model's rewrites, with spaces squeezed where the model says so; the identity for a model without either."""
        if self.rewrites:
            if self._starter is None:
                alone = "".join(re.escape(c) for c, x in self.rewrites.items() if not x[-1][0])
                first = "".join(re.escape(c) for c, x in self.rewrites.items() if x[0][0])
                second = "".join(map(re.escape, {r[0] for x in self.rewrites.values() for r, _ in x if r}))
                self._starter = re.compile("|".join([*([f"[{alone}]"] if alone else []), *([f"[{first}](?=[{second}])"] if first else [])]))
            out, at = [], 0
            for m in self._starter.finditer(text):
                k = m.start()
                if k >= at:
                    for rest, new in self.rewrites[m[0]]:
                        if text.startswith(rest, k + 1):
                            out += (text[at:k], new)
                            at = k + 1 + len(rest)
                            break
            text = "".join([*out, text[at:]])
        return re.sub(" +", " ", text).strip(" ") if self.squeeze else text

    def cutter(self) -> re.Pattern:
        """Cuts a normalised text where no piece goes over: before marks, between letters and certain signs, around certain controls."""
        if self._cutter is None:
            letter, alone, after = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "".join(self.alone), "".join(map(re.escape, self.after))
            loose = f"[^{MARK}{letter}{alone}]*"
            word = f"{MARK}*{loose}(?:[{letter}]+(?:[^{MARK}{letter}{after}{alone}]{loose})?)*"
            self._cutter = re.compile(f"[{alone}]|{word}" if alone else word)
        return self._cutter

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge, the last by rank, makes the piece; None if merging stops short of it."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda k: (self.rank.get(parts[k] + parts[k + 1], float("inf")), k))
            if parts[best] + parts[best + 1] not in self.rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def _agree(self, left: int, right: int) -> bool:
        """Whether merging by rank never joins across the border of two adjacent pieces."""
        pieces, rank, split = self.pieces, self.rank, self.split
        limit, tie = float("inf"), True
        while True:
            joined = rank.get(pieces[left] + pieces[right])
            if joined is not None and (joined < limit or tie and joined == limit):
                return False
            of_left, of_right = split[left], split[right]
            if of_left is None and of_right is None:
                return True
            # undo the later of the two pieces' last merges; of equal ones the right one came later
            if of_right is None or of_left is not None and rank[pieces[left]] > rank[pieces[right]]:
                limit, tie, left = rank[pieces[left]], False, of_left[1]
            else:
                limit, tie, right = rank[pieces[right]], True, of_right[0]

    def _fall_back(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.fallback else [self.unknown]

    def _matches(self, text: str, start: int) -> list[tuple[int, int]]:
        """The arcs out of a place, shortest first: (end, piece), piece -1 for fallback."""
        node, at, n = self.trie, start, len(text)
        found = []
        while at < n:
            node = node.get(text[at])
            if node is None:
                break
            at += 1
            if "" in node:
                found.append((at, node[""]))
        if not found or found[0][0] != start + 1:
            found.insert(0, (start + 1, -1))
        return found

    def _finite_path(self, text: str) -> list[tuple[int, int, int]]:
        """The one path of finite cost as (start, end, piece), found depth first.

        A prefix has one finite path, so a place that led nowhere never has to be
        entered again: the search is linear in the arcs.
        """
        n, width, pairs = len(text), len(self.pieces), self.pairs
        if len(pairs) > PAIRS_KEPT:
            pairs.clear()
        path: list[tuple[int, int, int]] = []
        left = [self._matches(text, 0)]
        stuck: set[int] = set()
        at, before = 0, -1
        while at < n:
            arcs = left[-1]
            while arcs:
                end, piece = arcs.pop()
                if end in stuck:
                    continue
                if before >= 0 and piece >= 0:
                    key = before * width + piece
                    fine = pairs.get(key)
                    if fine is None:
                        fine = pairs[key] = self._agree(before, piece)
                    if not fine:
                        continue
                path.append((at, end, piece))
                at, before = end, piece
                if at < n:
                    left.append(self._matches(text, at))
                break
            else:
                if not path:
                    raise AssertionError("no finite path")
                stuck.add(at)
                left.pop()
                at = path.pop()[0]
                before = path[-1][2] if path else -1
        return path

    def _cheapest_path(self, text: str) -> list[tuple[int, int, int]]:
        n = len(text)
        cost = [0.0] + [float("inf")] * n
        back: list[tuple[int, int, int]] = [(0, 0, -1)] * (n + 1)
        for start in range(n):
            for end, piece in self._matches(text, start):
                total = cost[start] + (self.fallback_cost if piece < 0 else self.costs[piece])
                if total < cost[end]:
                    cost[end], back[end] = total, (start, end, piece)
        path, at = [], n
        while at:
            path.append(back[at])
            at = back[at][0]
        return path[::-1]

    def _path(self, text: str) -> list[int]:
        path = self._finite_path(text) if self.kind == BPE else self._cheapest_path(text)
        out: list[int] = []
        for start, end, piece in path:
            if piece < 0:
                out += self._fall_back(text[start:end])
            else:
                out.append(piece)
        return out

    def path_bytes(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) > PARTS_KEPT:
                self.parts.clear()
            got = np.array(self._path(part), "<i4").tobytes()
            if len(part) <= 64:
                self.parts[part] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Piece ids (int32) of a whole text; a text that is empty or normalised to nothing has none."""
        text = self.normal(text)
        if not text:
            return np.zeros(0, "<i4")
        text = (MARK if self.dummy_prefix else "") + text.replace(" ", MARK)
        if self.squeeze:
            text = text.rstrip(MARK)
        ids = np.frombuffer(b"".join(map(self.path_bytes, self.cutter().findall(text))), "<i4")
        return ids if self.fallback else ids[~((ids == self.unknown) & (np.append(-1, ids[:-1]) == self.unknown))]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; broken byte runs become replacement characters."""
        text = b"".join(map(self.says.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if (self.dummy_prefix or self.squeeze) and text.startswith(" ") else text

    def state(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("parts", "pairs", "_cutter", "_starter")}

    @classmethod
    def from_state(cls, state: dict) -> Transducer:
        made = cls.__new__(cls)
        made.__dict__ |= state | {"parts": {}, "pairs": {}, "_cutter": None, "_starter": None}
        return made


def encode(docs: DataFrame, model: bytes, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id), ids array<int>, n_tokens, n_byte_tokens, round_trip.

    ``round_trip`` says that decoding the ids gives the text's normal form back (the text
    itself if the model has no normaliser); with byte fallback it fails only for texts that
    hold the space mark itself, which reads as a space.  Null and empty
    texts have no ids and round-trip to the empty text.  Row order, repeated rows and
    null keys stay as they are; columns outside ``keep`` are not read; a kept column may
    not be named like one that is added.
    """
    keep = ["doc_id"] if keep is None else keep
    no_clash(keep, ["ids", "n_tokens", "n_byte_tokens", "round_trip"])
    held = docs.sparkSession.sparkContext.broadcast(Transducer(model).state())
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.from_state(held.value)
        is_byte = np.array([t == BYTE for t in machine.types])
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = [t or "" for t in part.column("__text").to_pylist()]
                ids = [machine.encode(t) for t in texts]
                fine = [machine.decode(x) == machine.normal(t) for x, t in zip(ids, texts, strict=True)]
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
                n_byte = np.concatenate([[0], np.cumsum(is_byte[flat])])
                more = [pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32())), pa.array(np.diff(off).astype(np.int64)), pa.array(n_byte[off[1:]] - n_byte[off[:-1]]), pa.array(fine)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *more], names=[*keep, "ids", "n_tokens", "n_byte_tokens", "round_trip"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, "ids array<int>, n_tokens long, n_byte_tokens long, round_trip boolean"]))


def decode(encoded: DataFrame, model: bytes, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default doc_id) and ``decoded``, the text of each row's piece ids.

    Null and empty ids give the empty text; ids outside the vocabulary raise.  Row order,
    repeated rows and null keys stay as they are; a kept column may not be named ``decoded``.
    """
    keep = ["doc_id"] if keep is None else keep
    no_clash(keep, ["decoded"])
    held = encoded.sparkSession.sparkContext.broadcast(Transducer(model).state())
    rows = encoded.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer.from_state(held.value)
        for batch in batches:
            texts = [machine.decode(np.array(x or [], np.int32)) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, "decoded"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, "decoded string"]))
