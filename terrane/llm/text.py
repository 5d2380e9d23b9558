"""Vectorised word kernels over Arrow string arrays.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR.
Texts are laid out in one buffer with eight line feeds between them, so no
word, line or eight-byte load ever reaches into a neighbouring text.  Null
texts count as empty.  All kernels cost O(bytes) and hold one slice at a time
(see :func:`slices`), whatever the size of the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PAD = b"\n" * 8
SLICE_BYTES = 4 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = _LOWER.copy()
_PLAIN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 0x20
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U)
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD)
_LANES = 8  # words of more bytes than 8 * _LANES are hashed one by one


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most about ``limit`` bytes of text (one text may exceed it)."""
    size = np.diff(_offsets(batch.column(column)))
    if not len(size):
        return
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    got = np.frombuffer(texts.buffers()[1], dtype=kind) if texts.buffers()[1] else np.zeros(1, kind)
    return got[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One round of a 64-bit mixer; order matters."""
    h = (h ^ x) * _M1
    h ^= h >> _U(29)
    h *= _M2
    h ^= h >> _U(32)
    return h


class Words:
    """The words of some texts: byte offsets, owners and 64-bit hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False, plain: bool = False):
        """``lower`` folds A-Z; ``plain`` also reads ASCII punctuation as spaces."""
        raw = [x or b"" for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]
        self.n_docs = len(raw)
        self.bytes = b"".join((PAD, PAD.join(raw), PAD)) if raw else PAD * 2
        self.data = np.frombuffer(self.bytes, np.uint8)
        if lower or plain:
            self.data = (_PLAIN if plain else _LOWER)[self.data]
            self.bytes = self.data.tobytes()
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.doc_end = np.cumsum(size + 8)
        self.doc_start = self.doc_end - size
        edge = np.diff(_SPACE[self.data].view(np.int8))
        self.starts = np.flatnonzero(edge == -1) + 1
        self.ends = np.flatnonzero(edge == 1) + 1
        #: words of text k are off[k] .. off[k + 1]
        self.off = np.append(np.searchsorted(self.starts, self.doc_start), len(self.starts))

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.off)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.n_words)

    def word(self, k: int) -> bytes:
        return self.bytes[self.starts[k] : self.ends[k]]

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.bytes, self.starts, self.ends, seed)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; ``data`` must go on for eight bytes after the last span."""
    size = ends - starts
    lanes = np.ndarray((max(len(data) - 7, 0),), "<u8", buffer=data, strides=(1,))
    h = (size.astype(_U) + _U(seed)) * _M3
    if not len(size):
        return h
    h = mix(h, lanes[starts] & _MASK[np.minimum(size, 8)])
    rest = np.flatnonzero(size > 8)
    for k in range(1, _LANES):
        if not len(rest):
            return h
        left = size[rest] - 8 * k
        h[rest] = mix(h[rest], lanes[starts[rest] + 8 * k] & _MASK[np.minimum(left, 8)])
        rest = rest[left > 8]
    for k in rest.tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]], seed)
    return h


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[k]:off[k + 1]]; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, np.int64 if values.dtype.kind in "biu" else np.float64), np.cumsum(values, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)])
    return total[off[1:]] - total[off[:-1]]
