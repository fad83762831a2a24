"""Operator 1, chat formatting in budgeted windows.

Turns of a conversation are rendered in a template whose control strings cannot
occur inside texts: each occurrence there gets an escape mark after its first
character, and undoing that gives the text back.  Prefix sums of the turns'
tokens choose the windows: a window takes new turns while they fit the budget
beside the system turn, which every window repeats, and the newest turns before
it that fit the history budget and leave room for the next turn.  Repeated turns are context only, so the loss
mask covers each assistant text in exactly one window.

Rows are sorted by conversation and turn and streamed; a task holds one window
and the history, never a conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat templates, this one's first.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
)

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Goes after the first character of a control string inside a text.
MARK = "⁠"

_RAW = re.compile("|".join(f"{re.escape(c[0])}{MARK}*{re.escape(c[1:])}" for c in CONTROL))
_TOKEN = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    """No control string is left; each one, escaped before or not, has one mark more."""
    return _RAW.sub(lambda m: m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    return _RAW.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == MARK else m[0], text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def tokens(text: str) -> int:
    """Size of a text for the budget: words and punctuation marks, and four for the turn's frame."""
    return 4 + sum(1 for _ in _TOKEN.finditer(text))


@dataclass
class _State:
    """Of the conversation being read: its system turn, history and the open window."""

    conv: object
    system: tuple | None = None
    history: list = field(default_factory=list)
    turns: list = field(default_factory=list)
    upto: int = 0
    start: int = 0
    context: int = 0
    window: int = 0
    seen: int = 0


class Formatter:
    """Streams sorted turns into windows of at most ``budget`` tokens (a turn that is longer, alone or with the system turn, stays whole)."""

    def __init__(self, budget: int = 1024, history: int = 256):
        self.budget, self.keep = budget, history

    def windows(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """(conv_id, window, n_context, n_new, n_tokens, formatted, loss_starts, loss_ends) from (conv_id, role, text)."""
        state = None
        for conv, role, text in rows:
            if state is None or conv != state.conv:
                if state is not None:
                    yield self._close(state)
                state = _State(conv)
            turn = (role or "", text or "", tokens(text or ""))
            if state.turns and state.upto + turn[2] - state.start + self._fixed(state) > self.budget:
                yield self._close(state)
                self._open(state, turn[2])
            state.turns.append(turn)
            state.upto += turn[2]  # prefix sum over the conversation
        if state is not None:
            yield self._close(state)

    def _fixed(self, s: _State) -> int:
        return (s.system[2] if s.system and s.window else 0) + s.context

    def _open(self, s: _State, new: int) -> None:
        """Keeps the newest turns that fit the history budget and leave room for the system turn and ``new`` tokens, and starts the next window."""
        if s.window == 0 and s.turns and s.turns[0][0] == "system":
            s.system = s.turns.pop(0)
        room = min(self.keep, self.budget - new - (s.system[2] if s.system else 0))
        kept, size = [], 0
        for turn in reversed(s.history + s.turns):
            if size + turn[2] > room:
                break
            kept.append(turn)
            size += turn[2]
        s.history, s.context, s.turns, s.start, s.window = kept[::-1], size, [], s.upto, s.window + 1

    def _close(self, s: _State) -> tuple:
        again = ([s.system] if s.system and s.window else []) + s.history
        out, at, starts, ends = [], 0, [], []
        for k, (role, text, _) in enumerate(again + s.turns):
            head, body = f"{OPEN}{_role_out(role)}\n", escape(text)
            if k >= len(again) and role == "assistant" and body:
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            out += (head, body, CLOSE)
            at += len(head) + len(body) + len(CLOSE)
        return s.conv, s.window, len(again), len(s.turns), sum(t[2] for t in again + s.turns), "".join(out), starts, ends


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a window."""
    out = []
    for part in formatted.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        out.append((_role_in(role), unescape(body[: -len(CLOSE)])))
    return out


FORMAT_SCHEMA = "conv_id long, window long, n_context long, n_new long, n_tokens long, formatted string, loss_starts array<long>, loss_ends array<long>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("n_context", pa.int64()), ("n_new", pa.int64()), ("n_tokens", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))])
_READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def _rows(batches: Iterator[pa.RecordBatch], names: list[str], step: int = 512) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            yield from zip(*(part.column(n).to_pylist() for n in names))


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row for each window of each conversation, in order within a partition.

    Turns are ordered by turn, then role and text, so ties and repeated rows
    have a fixed order.  Null roles and texts count as empty, a null turn comes
    first, rows without conv_id form one conversation, other columns are
    ignored.  A leading turn of role ``system`` is repeated in every window.
    """
    def run(batches):
        chunk, size = [], 0
        for w in Formatter(budget, history).windows(_rows(batches, ["conv_id", "role", "text"])):
            chunk.append(w)
            size += len(w[5])
            if len(chunk) >= 500 or size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), _ARROW.types)], schema=_ARROW)
                chunk, size = [], 0
        if chunk:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*chunk), _ARROW.types)], schema=_ARROW)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMAT_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its windows: all turns in order, and the text under the loss mask.

    ``windows`` must come from ``format_conversations`` or be partitioned by
    conv_id and sorted by conv_id and window.  Hashes are fed window by window.
    """
    def run(batches):
        now, out = None, []
        for conv, _, n_context, formatted, starts, ends in _rows(batches, ["conv_id", "window", "n_context", "formatted", "loss_starts", "loss_ends"], 64):
            if now is None or conv != now[0]:
                if now is not None:
                    out.append(_done(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            for role, text in read_turns(formatted)[n_context:]:
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(starts, ends):
                text = unescape(formatted[a:b])
                now[3] += len(text)
                now[4].update(text.encode("utf-8", "surrogatepass"))
            now[5] += len(formatted)
            now[6] += 1
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        if now is not None:
            out.append(_done(now))
        if out:
            yield _batch(out)

    return windows.mapInArrow(run, _READ_SCHEMA)


def _done(now: list) -> tuple:
    return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5], now[6]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])
