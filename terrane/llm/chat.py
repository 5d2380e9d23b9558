"""Budgeted chat windows.

A conversation becomes one or more windows of at most ``max_tokens`` tokens of a
vocabulary (see :class:`Ranks`), a turn's two marks and last line feed counting one each.
Prefix sums of the turns' tokens choose turn-aligned spans; every window after the first
starts with the system turn and as much of the latest history as ``history_tokens``
allows, both masked, so each assistant text is a training target exactly once.  A
turn is never cut: one that exceeds the budget by itself stands in a window of its
own, which is then over budget and says so.

Turns are marked ``<|im_start|>role`` and ``<|im_end|>``; a backslash before ``|``
keeps control strings inside texts from reading as marks, and is taken out again by
:func:`parse`.  A conversation is streamed turn by turn in order, in memory bounded by
a window, by one task: the digest of a conversation is sequential by definition.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TOKENS = 2048
HISTORY_TOKENS = 256
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a turn's two marks and its last line feed.
MARK_TOKENS = 3
#: Rows that a task holds before it sends them.
HELD_ROWS = 4096
_TOKEN = re.compile(r"\w{1,6}|[^\w\s]|\s+")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def count_tokens(text: str) -> int:
    """A measure without a vocabulary: pieces of up to six word characters, other characters, and runs of white space."""
    return sum(1 for _ in _TOKEN.finditer(text))


class Ranks:
    """The measure of a byte-level vocabulary: a rank file's content, sent once to every worker, and its pre-tokenising pattern."""

    def __init__(self, spark: SparkSession, ranks: bytes, pattern: str):
        self.held = spark.sparkContext.broadcast((ranks, pattern))
        self.encoding = None

    def __getstate__(self) -> dict:
        return {"held": self.held, "encoding": None}

    def __call__(self, text: str) -> int:
        if self.encoding is None:
            import base64

            import tiktoken

            ranks, pattern = self.held.value
            merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines())}
            self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        return len(self.encoding.encode_ordinary(text))


@dataclass
class Turn:
    role: str
    text: str
    tokens: int


@dataclass
class _State:
    """One conversation on its way through a partition."""

    conv: int | None
    window: int = 0
    system: Turn | None = None
    history: deque = field(default_factory=deque)
    history_size: int = 0
    #: turns not yet written, and their prefix sums
    open: list = field(default_factory=list)
    sums: list = field(default_factory=lambda: [0])
    seen: int = 0


def _render(conv: int | None, window: int, repeated: list[Turn], new: list[Turn], max_tokens: int) -> dict:
    out, at, starts, ends = [], 0, [], []
    for k, turn in enumerate([*repeated, *new]):
        head, body = f"{START}{escape_role(turn.role)}\n", escape(turn.text)
        if k >= len(repeated) and turn.role == "assistant":
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += (head, body, END, "\n")
        at += len(head) + len(body) + len(END) + 1
    tokens = sum(t.tokens for t in repeated) + sum(t.tokens for t in new)
    return {"conv_id": conv, "window": window, "text": "".join(out), "loss_start": starts, "loss_end": ends, "n_repeated": len(repeated), "n_turns": len(new), "n_tokens": tokens, "over_budget": tokens > max_tokens}


def _close(s: _State, upto: int, max_tokens: int, history_tokens: int) -> dict:
    """Write the first ``upto`` open turns as a window and move them into the history."""
    new, s.open = s.open[:upto], s.open[upto:]
    base = s.sums[upto]
    s.sums = [x - base for x in s.sums[upto:]]
    repeated = ([s.system] if s.system and s.window else []) + list(s.history)
    row = _render(s.conv, s.window, repeated, new, max_tokens)
    s.window += 1
    for turn in new:
        if turn is s.system:
            continue
        s.history.append(turn)
        s.history_size += turn.tokens
    while s.history and s.history_size > history_tokens:
        s.history_size -= s.history.popleft().tokens
    return row


def _advance(s: _State, max_tokens: int, history_tokens: int, done: bool) -> Iterator[dict]:
    while s.open:
        fixed = (s.system.tokens if s.system and s.window else 0) + s.history_size
        # history gives way to a turn that needs the room
        while s.history and fixed + s.open[0].tokens > max_tokens:
            gone = s.history.popleft().tokens
            s.history_size -= gone
            fixed -= gone
        fit = max(1, int(np.searchsorted(s.sums, max_tokens - fixed, side="right")) - 1)
        if fit >= len(s.open) and not done:
            return
        yield _close(s, min(fit, len(s.open)), max_tokens, history_tokens)


SCHEMA = "conv_id long, window long, text string, loss_start array<long>, loss_end array<long>, n_repeated long, n_turns long, n_tokens long, over_budget boolean"
_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss_start", pa.list_(pa.int64())), ("loss_end", pa.list_(pa.int64())), ("n_repeated", pa.int64()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("over_budget", pa.bool_())])
_NONE = object()


def windows(conversations: DataFrame, max_tokens: int = MAX_TOKENS, history_tokens: int = HISTORY_TOKENS, measure=count_tokens) -> DataFrame:
    """Windows (see SCHEMA) of rows (conv_id, turn, role, text).

    Turns go by ``turn`` (nulls first), equal ones by role and text; repeated rows
    are turns of their own.  Null roles and texts are empty.  A null conv_id is one
    conversation.  The system turn is the first turn if its role is ``system``.  Loss
    spans are code points of ``text`` that hold this window's new assistant texts.  An
    empty table gives no windows; extra columns are not read.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: _State | None = None
        out: list[dict] = []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if state is None or state.conv != conv:
                    if state is not None:
                        out += _advance(state, max_tokens, history_tokens, True)
                    state = _State(conv)
                turn = Turn(role, text, measure(escape(text)) + measure(f"{escape_role(role)}\n") + MARK_TOKENS)
                if state.seen == 0 and role == "system":
                    state.system = turn
                state.seen += 1
                state.open.append(turn)
                state.sums.append(state.sums[-1] + turn.tokens)
                if state.sums[-1] > max_tokens - history_tokens:
                    out += _advance(state, max_tokens, history_tokens, False)
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out = []
        if state is not None:
            out += _advance(state, max_tokens, history_tokens, True)
        if out:
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return ordered.mapInArrow(run, SCHEMA)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window, unescaped; anything between turns raises."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long, n_over_budget long"


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation (see DIGEST), read back from its windows in order: repeated turns are skipped, loss spans unescaped."""
    rows = formatted.select("conv_id", "window", "text", "loss_start", "loss_end", "n_repeated", "over_budget")
    ordered = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = _NONE
        out: list[tuple] = []
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST.split(", ")]

        def done() -> None:
            if now is not _NONE:
                out.append((now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_windows, over))

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if now is _NONE or row["conv_id"] != now:
                    done()
                    now, n_turns, loss_chars, chars, n_windows, over = row["conv_id"], 0, 0, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(row["text"])[row["n_repeated"] :]:
                    turns.update(f"{role}\n{text}\n".encode())
                    n_turns += 1
                for a, b in zip(row["loss_start"], row["loss_end"], strict=True):
                    target = unescape(row["text"][a:b])
                    loss.update(target.encode())
                    loss_chars += len(target)
                chars += len(row["text"])
                n_windows += 1
                over += row["over_budget"]
            if len(out) >= HELD_ROWS:
                yield send()
                out.clear()
        done()
        yield send()

    return ordered.mapInArrow(run, DIGEST)
