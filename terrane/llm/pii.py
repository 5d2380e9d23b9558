"""Personal data: base patterns, and offset-preserving deobfuscation.

Disguised identifiers are found on a normalised copy of the text that a cascade of
transducers writes: look-alike letters and digits, invisible characters, bracketed
or spelled at and dot, spelled digits.  Every output character carries the source
span it came from, so matches on the copy map back to the source exactly.  Base
matches on the source itself always stay; a match on the copy is added unless it
lies within one of its kind.

Spelled at and dot without brackets are read in any case and with up to three blanks:
``name dot name at host dot ending`` (any ending of 2 to 24 letters, the host no article
or the like), four numbers, and ``name at host.ending`` where a mark or digit in the
name, the start of a line or a word such as mail or contact tells it from prose.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import no_clash
from .text import slices

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, failing ones dropped; linear in the text but for short runs."""
    found = emails(text) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-9:]) <= 255 for x in m.groups()):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# Characters that look like an ASCII one (Cyrillic, Greek, other signs).
_LOOK_ALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
    "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ı": "i", "․": ".", "。": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ",
}
#: Full-width forms lie at a fixed distance from ASCII.
_LOOK_ALIKE |= {chr(0xFEE0 + k): chr(k) for k in range(0x21, 0x7F)}
#: Digits of other scripts, by the first of their ten code points.
_LOOK_ALIKE |= {chr(zero + k): str(k) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for k in range(10)}
#: Invisible characters say nothing.
_LOOK_ALIKE |= dict.fromkeys("­​‌‍⁠﻿", "")

# Digits as words.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: Case folding reads these as s and k.
_LOOK_ALIKE |= {"ſ": "s", "\u212a": "K"}

_ODD = re.compile("[" + re.escape("".join(_LOOK_ALIKE)) + "]")
_WORD = "(?:" + "|".join(_SPELLED) + ")"
_DIGITS = re.compile(rf"(?:(?:\bplus\b|\+)[ -]?)?\b{_WORD}\b(?:[ ,-]{{1,3}}(?:{_WORD}\b|[0-9]++))+", re.I)
_SPELLED_RUN = re.compile(rf"\b{_WORD}[ ,-]{{1,3}}(?:{_WORD}\b|[0-9])")
_PIECE = re.compile(rf"(?P<plus>\bplus\b)|(?P<word>{_WORD})", re.I)
_BRACKET_AT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:at|@)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
_BRACKET_DOT = re.compile(r"[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|\.)[ \t]{0,3}[\])}>][ \t]{0,3}", re.I)
# Bare words, in any case, only inside a whole address (name at host dot ending) or between the numbers of an IP.
# Words that stand before a dot or an at in prose, so no host or name.
_NO_HOST = "(?!(?:the|this|that|these|those|a|an|each|every|any|one|some|another|first|last|red|my|your|his|her|its|our|their|polka|www)\\b)"
_NO_NAME = "(?!(?:us|me|it|look|looks|looked|looking|available|found|visit|works?|worked|hosted|located|here|there|online|is|are|was|were|and|or|page|site|website|more|live|lives|start|meet|that|this|them)[ \\t])"
_CUE = r"(?:(?:^|[\n:;,(<\"']|\b(?:e-?mail|mail|contact|write|writing|reach|send|ask|address|from|to|cc|bcc|is)\b)[ \t]{0,3})"
_AT, _DOT = r"[ \t]{1,3}at[ \t]{1,3}", r"[ \t]{1,3}dot[ \t]{1,3}"
_LABEL = "[A-Za-z0-9-]{1,63}"
_PART = "[A-Za-z0-9._%+-]{1,64}"
_SPELLED_AT = rf"(?:{_AT}|@)"
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{_PART}{_DOT}){{0,3}}{_PART}{_SPELLED_AT}{_NO_HOST}{_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{0,3}}?{_DOT}(?:{_LABEL}(?:{_DOT}|\.)){{0,2}}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I)
# A name at host.ending may be prose: the name has a digit or mark inside, or a cue or the start of a line before it.
_BARE_AT = re.compile(rf"(?:(?<![A-Za-z0-9._%+-])(?=[A-Za-z]*[0-9._%+-])|{_CUE}(?<![A-Za-z0-9._%+-])){_NO_NAME}{_PART}(?P<at>{_AT})(?!www\.){_LABEL}(?:\.{_LABEL}){{0,3}}\.[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I | re.M)
_BARE_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_BARE_PART = re.compile(rf"{_AT}|{_DOT}", re.I)
_SPELLED_MARK = re.compile(r"[ \t]dot[ \t]|[ \t]at[ \t]{1,3}[a-z0-9-]+\.[a-z0-9]")


class Copy:
    """A normalised text whose every character knows its source span."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | range = range(len(text))
        self.end: list[int] | range = range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ordered, disjoint ranges; characters written for a range map to the whole range."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            start += self.start[at:a]
            end += self.end[at:a]
            if new:
                start += [self.start[a]] * len(new)
                end += [self.end[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        start += self.start[at:]
        end += self.end[at:]
        self.text, self.start, self.end = "".join(text), start, end

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def disguised(text: str) -> bool:
    """A necessary condition for the cascade to change the text: any look-alike, whatever stands beside it, or a spelled mark or digit."""
    if not text.isascii() and _ODD.search(text):
        return True
    lower = text.lower()
    if _SPELLED_MARK.search(lower) or _BRACKET_AT.search(text):
        return True
    return bool(_BRACKET_DOT.search(text) or _SPELLED_RUN.search(lower))


def normalise(text: str) -> Copy:
    """The cascade: characters, bracketed at and dot, bare at and dot inside an address, spelled digits."""
    copy = Copy(text)
    if not text.isascii():
        copy.rewrite([(k, k + 1, _LOOK_ALIKE[c]) for k, c in enumerate(text) if c in _LOOK_ALIKE])
    for pattern, mark in ((_BRACKET_AT, "@"), (_BRACKET_DOT, ".")):
        copy.rewrite([(m.start(), m.end(), mark) for m in pattern.finditer(copy.text)])
    for pattern in (_BARE, _BARE_IP):
        copy.rewrite([(m.start() + p.start(), m.start() + p.end(), "@" if p[0].strip().lower() == "at" else ".") for m in pattern.finditer(copy.text) for p in _BARE_PART.finditer(m[0])])
    copy.rewrite([(*m.span("at"), "@") for m in _BARE_AT.finditer(copy.text)])
    edits = []
    for m in _DIGITS.finditer(copy.text):
        parts = [*_PIECE.finditer(m[0])]
        # between two spelled digits there is nothing to keep
        for k, p in enumerate(parts):
            a, b = p.start(), p.end()
            while b < len(m[0]) and m[0][b] in " ,-" and (k + 1 < len(parts) or p["plus"] or m[0][b:].strip(" ,-")):
                b += 1
            edits.append((m.start() + a, m.start() + b, "+" if p["plus"] else _SPELLED[p[0].lower()]))
    copy.rewrite(edits)
    return copy


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each ordered by kind as in KINDS and then start; null counts as empty."""
    text = text or ""
    order = {k: n for n, k in enumerate(KINDS)}
    base = sorted(base_spans(text), key=lambda s: (order[s[0]], s[1]))
    if not disguised(text):
        return base, base
    copy = normalise(text)
    every = list(base)
    # base spans of a kind are disjoint, so only the last one that starts before can hold another
    starts = {k: [s[1] for s in base if s[0] == k] for k in KINDS}
    ends = {k: [s[2] for s in base if s[0] == k] for k in KINDS}
    for kind, a, b in base_spans(copy.text):
        a, b = copy.source(a, b)
        n = bisect_right(starts[kind], a)
        if not n or ends[kind][n - 1] < b:
            every.append((kind, a, b))
    return base, sorted(set(every), key=lambda s: (order[s[0]], s[1], s[2]))


def show(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span's characters replaced by its kind in capitals; overlapping spans become one, named after the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += (text[at:a], f"<{kind.upper()}>")
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string"


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, redacted: bool = True) -> DataFrame:
    """Columns ``keep`` (default doc_id), base counts by kind, the digest of the base spans, all spans, how many were added, the redacted text.

    Null and empty texts have no spans (the digest of the empty string; a null text
    stays null when redacted).  Repeated rows give repeated rows, null keys stay,
    columns outside ``keep`` are not read; a kept column may not be named like one that
    is added.
    """
    keep = ["doc_id"] if keep is None else keep
    no_clash(keep, [x.split()[0] for x in SCHEMA.split(", ")])
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                counts: list[list[int]] = [[] for _ in KINDS]
                sha, spans, added, clean = [], [], [], []
                for text in part.column("__text").to_pylist():
                    base, every = find(text)
                    for n, kind in zip(counts, KINDS, strict=True):
                        n.append(sum(s[0] == kind for s in base))
                    sha.append(hashlib.sha256(show(base).encode()).hexdigest())
                    spans.append(show(every))
                    added.append(len(every) - len(base))
                    clean.append(redact(text, every) if redacted else None)
                more = [*(pa.array(n, pa.int64()) for n in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64()), pa.array(clean, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *more], names=[*keep, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "redacted"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(run, ", ".join([*kinds, SCHEMA]))
