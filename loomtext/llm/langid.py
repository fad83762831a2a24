"""Operator 4, language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A text is
parsed greedily into the longest phrases that the automaton knows; the fewer
phrases, the closer the language.  A phrase costs log2 of the training length
bits, so the entropy per character is phrases * log2(training) / length; the
language with the least wins and the gap to the second gives the score.  A
letter that the training text lacks counts as two phrases, an escape and itself;
else a language with little training text would have strange letters cheapest.

The parse of a whole text is one run of a table: it holds, for a character that
ends the phrase, the state that the character opens, with one bit to count it.
Blocks of ``BLOCK`` characters of all texts run side by side in numpy, at first
as if each began a phrase; then each is entered again with the state its
predecessor left, until the two runs meet, which they do after a few phrases.
Where they never meet, the text is run on character by character.  So the count
is that of the whole text, wherever blocks end.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import map_pieces

#: Labelled rows that a language is learned from, at most; rows of more characters are taken only where shorter ones are too few.
ROWS, MODERATE = 24, 20_000
#: Characters of a block, and of a text that are parsed at a time.
BLOCK, SEGMENT = 256, 1 << 20
#: Entries of an automaton that are kept as a full table; a larger one (many letters) is searched.
DENSE = 8 << 20

#: Symbols: no letter; a letter that is not in the language's training text.
_GAP, _OTHER = 0, 1
_NEW = 1 << 30


@functools.cache
def _plain_codes() -> np.ndarray:
    """The symbol of each code point before any letter is known."""
    return np.array([_OTHER if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else _GAP for c in range(0x110000)], np.int32)


class Automaton:
    """Suffix automaton of a symbol sequence; a state and a symbol give the next state, with a bit where a phrase begins."""

    def __init__(self, seq: list[int], symbols: int, dense: int = DENSE):
        step: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for s in seq:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and s not in step[p]:
                step[p][s] = cur
                p = link[p]
            if p >= 0:
                q = step[p][s]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(step)
                    step.append(dict(step[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(s) == q:
                        step[p][s] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        states = len(step) + 1  # the last state: after a symbol that is a phrase of its own
        self.symbols = symbols
        self.opens = np.full(symbols, states - 1, np.int32) + _NEW
        for s, to in step[0].items():
            self.opens[s] = to + _NEW
        keys = np.array([state * symbols + s for state, out in enumerate(step) for s in out], np.int64)
        to = np.array([to for out in step for to in out.values()], np.int32)
        self.table = None
        if states * symbols <= dense:
            self.table = np.tile(self.opens, states)
            self.table[keys] = to
            self.cells = memoryview(self.table)
        else:
            order = np.argsort(keys)
            self.keys, self.to = keys[order], to[order]
            self.cells = memoryview(self.keys)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at = state * np.int64(self.symbols) + symbol
        if self.table is not None:
            return self.table[at]
        if not len(self.keys):
            return self.opens[symbol]
        k = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where(self.keys[k] == at, self.to[k], self.opens[symbol])

    def one(self, state: int, symbol: int) -> int:
        at = state * self.symbols + symbol
        if self.table is not None:
            return self.cells[at]
        k = bisect.bisect_left(self.cells, at)
        return int(self.to[k] if k < len(self.cells) and self.cells[k] == at else self.opens[symbol])


def count_phrases(automaton: Automaton, flat: np.ndarray, sizes: np.ndarray, carry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, last state) of each text; ``flat`` holds their symbols one after the other.

    ``carry`` is the state that a text goes on from, -1 where it begins.  A
    phrase counts where it begins.  Texts are not empty.
    """
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    begins = np.cumsum(sizes) - sizes
    start = begins[owner] + (np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]) * BLOCK
    long = np.minimum(BLOCK, begins[owner] + sizes[owner] - start)
    heads = start == begins[owner]

    # all blocks at once, as if each began a phrase; those that begin a text go on from its carry
    order = np.argsort(-long, kind="stable")  # blocks that end leave from the back
    own_start, alive = start[order], np.searchsorted(-long[order], -np.arange(BLOCK), "left")
    state, bit = np.zeros(len(flat), np.int32), np.zeros(len(flat), np.int8)
    v = automaton.opens[flat[own_start]]
    given = np.flatnonzero(heads[order] & (carry[owner[order]] >= 0))
    v[given] = automaton.step(carry[owner[order][given]], flat[own_start[given]])
    for i in range(BLOCK):
        m = int(alive[i])
        if not m:
            break
        at = own_start[:m] + i
        if i:
            v = automaton.step(now[:m], flat[at])
        now = v & (_NEW - 1)
        state[at], bit[at] = now, v >> 30

    # each block again from the state before it, until both runs agree
    change = np.zeros(len(owner), np.int64)
    lane = np.flatnonzero(~heads)
    now = state[start[lane] - 1]
    open_ = []
    for i in range(BLOCK):
        over = long[lane] == i
        open_ += lane[over].tolist()
        lane, now = lane[~over], now[~over]
        if not len(lane):
            break
        at = start[lane] + i
        v = automaton.step(now, flat[at])
        now = v & (_NEW - 1)
        change[lane] += (v >> 30) - bit[at]
        apart = now != state[at]
        lane, now = lane[apart], now[apart]
    open_ += lane.tolist()

    # blocks whose runs never met: on from there, symbol by symbol, until they do
    walked = -1
    for b in sorted(open_):
        if b <= walked:
            continue
        at, stop = int(start[b]), int(begins[owner[b]] + sizes[owner[b]])
        now, more = int(state[at - 1]), 0
        while at < stop:
            v = automaton.one(now, int(flat[at]))
            now = v & (_NEW - 1)
            more += (v >> 30) - int(bit[at])
            if now == state[at]:
                break
            state[at] = now
            at += 1
        walked = b + (min(at, stop - 1) - int(start[b])) // BLOCK
        change[b : walked + 1] = 0
        change[b] = more
    phrases = np.add.reduceat(bit.astype(np.int64), begins) + np.bincount(owner, change, len(sizes)).astype(np.int64)
    return phrases, state[begins + sizes - 1]


class Model:
    """The automata of all languages, each over the letters of its own training text."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.code = _plain_codes().copy()
        letters: dict[str, int] = {}
        for t in texts.values():
            for c in set(t):
                if c.isalpha():
                    low = c.lower() if len(c.lower()) == 1 else c
                    symbol = letters.setdefault(low, len(letters) + 2)
                    for form in (c, low, low.upper()):
                        if len(form) == 1:
                            self.code[ord(form)] = symbol
        self.own, self.bits, self.automata = [], [], []
        for lang in self.langs:
            codes = self.encode(texts[lang])
            there = np.unique(codes[codes > _OTHER])
            own = np.full(len(letters) + 2, _OTHER, np.int32)
            own[_GAP] = _GAP
            own[there] = np.arange(2, len(there) + 2)
            self.own.append(own)
            self.automata.append(Automaton(own[codes].tolist(), len(there) + 2))
            self.bits.append(math.log2(max(2, len(codes))))

    def encode(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def parse(self, codes: list[np.ndarray], carry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Phrases [text, language] and last states of texts that are not empty."""
        out = np.zeros((len(codes), len(self.langs)), np.int64)
        last = np.full(out.shape, -1, np.int32)
        if len(codes):
            flat, sizes = np.concatenate(codes), np.array([len(c) for c in codes])
            for k, automaton in enumerate(self.automata):
                own = self.own[k][flat]
                out[:, k], last[:, k] = count_phrases(automaton, own, sizes, last[:, k] if carry is None else carry[:, k])
                out[:, k] += np.add.reduceat((own == _OTHER).astype(np.int64), np.cumsum(sizes) - sizes)
        return out, last

    def _long(self, text: str) -> tuple[np.ndarray, bool]:
        """Phrases of one long text, by segments, and whether it has a letter."""
        total, carry, letter = 0, None, False
        for at in range(0, len(text), SEGMENT):
            codes = self.encode(text[at : at + SEGMENT])
            letter = letter or bool((codes > _GAP).any())
            phrases, carry = self.parse([codes], carry)
            total = total + phrases[0]
        return total, letter

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; ("und", 0) without a letter or a model."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.langs:
            return out
        codes = {d: self.encode(t) for d, t in enumerate(texts) if t and len(t) <= SEGMENT}
        codes = {d: c for d, c in codes.items() if (c > _GAP).any()}
        phrases = dict(zip(codes, self.parse(list(codes.values()))[0]))
        for d, t in enumerate(texts):
            if t and len(t) > SEGMENT:
                found, letter = self._long(t)
                if letter:
                    phrases[d] = found
        for d, n in phrases.items():
            cost = n * np.array(self.bits) / len(texts[d])
            order = np.argsort(cost, kind="stable")  # ties: the first by name
            second = cost[order[1]] if len(order) > 1 else 2 * cost[order[0]]
            out[d] = self.langs[order[0]], float(min(1.0, (second - cost[order[0]]) / second))
        return out


def sample(labelled: DataFrame, rows: int = ROWS, moderate: int = MODERATE) -> dict[str, str]:
    """Training text for each language: the whole texts of at most ``rows`` labelled rows, those whose ids hash lowest.

    Rows of more than ``moderate`` characters come after all others; equal rows
    count once.  Rows with null or empty text or null language are left out.
    """
    known = labelled.filter("text is not null and lang is not null and length(text) > 0").withColumn("h", F.xxhash64("doc_id", F.crc32("text")))
    order = Window.partitionBy("lang").orderBy("long", "h")
    ranked = known.select("lang", "h", (F.length("text") > moderate).alias("long")).withColumn("r", F.dense_rank().over(order))
    chosen = ranked.filter(F.col("r") <= rows).select("lang", "h", "r").distinct()  # few and without texts, which come in a second scan
    picked = known.select("lang", "h", "text").join(F.broadcast(chosen), ["lang", "h"]).select("lang", "r", "text").distinct()
    texts: dict[str, list[str]] = {}
    for r in sorted(picked.collect()):
        texts.setdefault(r.lang, []).append(r.text)
    return {k: "\n".join(v) for k, v in texts.items()}


_models: dict[bytes, Model] = {}


def identify(docs: DataFrame, texts: dict[str, str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred and score for each row; ``texts`` are training texts by language.

    Whole texts are parsed.  Null text, and text without a letter, is ``und``
    with score 0.  Workers build the automata once from the few training
    texts that travel with the task.
    """
    key = hashlib.sha256(repr(sorted(texts.items())).encode("utf-8", "surrogatepass")).digest()

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _models:
            _models.clear()
            _models[key] = Model(texts)
        found = _models[key].predict(piece.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "score"])

    own = docs.select(*keep, "text")
    fields = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keep)
    return own.mapInArrow(map_pieces(run), f"{fields}, lang_pred string, score double")
