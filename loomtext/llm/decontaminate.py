"""Operator 7, benchmark decontamination: seeds, then local alignment.

Three words of a test item, in a row or with one left out, are a seed, however
frequent: copies of an item raise the counts of just those seeds that survive
their edits.  The words of a passage are taken in a row or with one or two left
out, so edits of each third word leave seeds.  An alignment without a seed
scores at most n / 2 + 3 for n words of an item, which is below the threshold
for items of 7 to 73 words; of shorter ones each word is a seed, and of longer
ones an alignment without a seed needs more than 73 words of the item.  A seed found in
a passage opens a window around its diagonal that holds any alignment through
it which reaches the threshold.  Windows whose words cannot reach it, by a bound
from above, are left; Smith-Waterman aligns the others word by word with the
item.  The score is the best alignment over the score of an exact copy, so
substitutions, insertions and deletions lower it smoothly.

The items are broadcast in blocks of ``BLOCK_BYTES`` of text, which the driver
reads one after the other.  A larger benchmark takes one pass over the corpus
for each block, with equal results.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from loomtext.llm.common import Staging, map_pieces
from loomtext.llm.textvec import _BASE, PUNCT_BYTES, hash_words, mix

#: Words of a seed; their places in an item and in a passage; items with fewer than ``SMALL`` words have each word as a seed.
SEED, SMALL = 3, 7
ITEM_PLACES = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
TEXT_PLACES = (*ITEM_PLACES, (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: Alignment score, as a share of an exact copy's, from which a passage counts as a leak.
THRESHOLD = 0.5
#: The score of as many words in a row is a leak too, however long the item.
LONG = 20
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 4 << 20


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences and the window position it ends at (first of equals)."""
    j = np.arange(len(window)) * -GAP
    row = np.zeros(len(window) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        step = np.where(window == w, MATCH, MISMATCH)
        t = np.maximum(np.maximum(row[:-1] + step, row[1:] + GAP), 0)
        t = np.maximum(np.maximum.accumulate(t + j) - j, 0)
        row[1:] = t
        k = int(t.argmax())
        if t[k] > best:
            best, end = int(t[k]), k + 1
    return best, end


def passages(item: np.ndarray, known: tuple[np.ndarray, np.ndarray], window: np.ndarray, need: int) -> list[tuple[int, int, int]]:
    """(score, start, end) of local alignments of at least ``need``, best first; no two overlap and none is left between them."""
    out, gaps = [], [(0, len(window))]
    while gaps:
        a, b = gaps.pop()
        if not reaches(known, window[a:b], need):
            continue
        score, start = _ends(item, window[a:b])
        at = np.flatnonzero(score >= need)
        free = np.ones(b - a, bool)
        found = []
        for k in at[np.argsort(-score[at], kind="stable")].tolist():
            x, y = int(start[k]), k + 1
            if free[x:y].all():
                free[x:y] = False
                found.append((x, y))
                out.append((int(score[k]), a + x, a + y))
        if found:
            found.sort()
            gaps += [(a + x, a + y) for x, y in zip([0, *(f[1] for f in found)], [*(f[0] for f in found), b - a]) if x < y]
    return out


def reaches(known: tuple[np.ndarray, np.ndarray], window: np.ndarray, need: int) -> bool:
    """False only where no alignment reaches ``need``: no run of either side has enough words that the other side has, misses subtracted.

    ``known`` is the item as its sorted words and each word's place among them.
    """
    own, places = known
    k = np.minimum(np.searchsorted(own, window), len(own) - 1)
    there = own[k] == window
    if MATCH * np.count_nonzero(there) < need:
        return False
    met = np.zeros(len(own), bool)
    met[k[there]] = True
    for hit in (met[places], there):
        total = np.where(hit, MATCH, max(MISMATCH, GAP)).cumsum()
        low = np.minimum(np.minimum.accumulate(total), 0)
        if total[0] < need and (total[1:] - low[:-1]).max(initial=0) < need:
            return False
    return True


def _ends(item: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window position the best alignment that ends there, as its score and its (latest) start."""
    unit = 1 << 32  # score * unit + start
    n = np.arange(len(window) + 1, dtype=np.int64)
    j, row = n[1:] * (-GAP * unit), n.copy()
    best = np.zeros(len(window), np.int64)
    for w in item:
        step = np.where(window == w, MATCH * unit, MISMATCH * unit)
        t = np.maximum(np.maximum(row[:-1] + step, row[1:] + GAP * unit), n[1:])
        t = np.maximum.accumulate(t + j) - j
        row[1:] = np.maximum(t, n[1:])
        np.maximum(best, row[1:], out=best)
    return best >> 32, best & (unit - 1)


def gapped(h: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hashes of the words at ``places`` from each position that has them all."""
    n = max(0, len(h) - places[-1])
    out = np.zeros(n, np.uint64)
    for k in places:
        out = out * _BASE + h[k : k + n]
    return mix(out)


class Items:
    """Hashed words and seeds of a block of test items; about 80 bytes for each of their words."""

    def __init__(self, ids: pa.Array | list, texts: list[str | None]):
        words = hash_words(pa.array(texts, pa.string()), PUNCT_BYTES)
        self.ids = ids if isinstance(ids, pa.Array) else pa.array(ids)
        self.words = [words.of(d).copy() for d in range(len(texts))]
        self.known = [np.unique(h, return_inverse=True) for h in self.words]
        self.places = (*TEXT_PLACES, (0,)) if any(SEED <= len(h) < SMALL for h in self.words) else TEXT_PLACES
        self.short = [k for k, h in enumerate(self.words) if 0 < len(h) < SEED]
        seeds, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for k, h in enumerate(self.words):
            for places in ITEM_PLACES if len(h) >= SMALL else ((0,),) if len(h) >= SEED else ():
                g = gapped(h, places)
                seeds.append(g)
                item.append(np.full(len(g), k, np.int32))
                at.append(np.arange(len(g), dtype=np.int32))
        seeds = np.concatenate(seeds)
        order = np.argsort(seeds, kind="stable")
        self.item, self.at = np.concatenate(item)[order], np.concatenate(at)[order]
        self.seeds, first = np.unique(seeds[order], return_index=True)
        self.first = np.append(first, len(order))  # places of seed k: item and at from first[k] to first[k + 1]
        self.maybe = None

    def _mask(self) -> tuple[np.uint64, np.ndarray]:
        """Low bits that a seed may have, 32 slots a seed; made where it is used, not shipped."""
        if self.maybe is None:
            low = np.uint64((1 << min(24, max(16, (32 * len(self.seeds)).bit_length()))) - 1)
            there = np.zeros(int(low) + 1, bool)
            there[(self.seeds & low).astype(np.int64)] = True
            self.maybe = low, there
        return self.maybe

    def hits(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word position, number of the seed) of the seeds in a batch."""
        low, there = self._mask()
        out = []
        for places in self.places:
            g = gapped(words.h, places)
            at = np.flatnonzero(there[(g & low).astype(np.int64)])
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(self.seeds, g[at]), len(self.seeds) - 1)
            same = self.seeds[k] == g[at]
            at, k = at[same], k[same]
            doc = np.searchsorted(words.first, at, "right") - 1
            whole = at + places[-1] < words.first[doc + 1]
            out.append((doc[whole], at[whole] - words.first[doc[whole]], k[whole]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip((none, none, none), *out))

    def spans(self, words, d: int, found: list[tuple[int, int]]) -> list[tuple[int, float, int, int]]:
        """(item, score, first word, word after the last) of one document's leaks; found: (number of the seed, position)."""
        windows = defaultdict(set)
        for g, p in found:
            own = slice(self.first[g], self.first[g + 1])
            for k, q in zip(self.item[own].tolist(), self.at[own].tolist()):
                windows[k].add(p - q)
        h, out = words.of(d), []
        for k, diagonals in sorted(windows.items()):
            item = self.words[k]
            n, need = len(item), self.need(k)
            reach = MATCH * n - need  # more insertions cost more than all the matches give above the threshold
            merged = []
            for p in sorted(diagonals):
                a, b = max(0, p - reach), min(len(h), p + n + reach)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            own = [(k, best / (MATCH * n), a + x, a + y) for a, b in merged for best, x, y in passages(item, self.known[k], h[a:b], need)]
            out += sorted(own, key=lambda s: s[2])
        return out

    def need(self, k: int) -> int:
        """The least alignment score that makes a leak of item k."""
        return min(int(np.ceil(THRESHOLD * MATCH * len(self.words[k]))), MATCH * LONG)

    def short_spans(self, h: np.ndarray) -> list[tuple[int, float, int, int]]:
        """Items shorter than a seed count where they stand word for word."""
        out = []
        for k in self.short:
            w = self.words[k]
            at = np.flatnonzero(h[: len(h) - len(w) + 1] == w[0]) if len(h) >= len(w) else []
            out += [(k, 1.0, int(p), int(p) + len(w)) for p in at if (h[p : p + len(w)] == w).all()]
        return out

    def leaks(self, column: pa.Array) -> list[list[tuple[int, float, int, int]]]:
        """The leaks of each text."""
        words = hash_words(column, PUNCT_BYTES)
        by_doc = defaultdict(list)
        for d, p, g in zip(*(x.tolist() for x in self.hits(words))):
            by_doc[d].append((g, p))
        out = [self.spans(words, d, by_doc[d]) if d in by_doc else [] for d in range(len(column))]
        if self.short:
            out = [o + self.short_spans(words.of(d)) for d, o in enumerate(out)]
        return out


def _blocks(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The items in bounded blocks, each broadcast before the next is read; null texts are no items."""
    sc, kind = benchmark.sparkSession.sparkContext, to_arrow_type(benchmark.schema["item_id"].dataType)
    kept = benchmark.select("item_id", "text").filter("text is not null").orderBy("item_id", "text")
    ids, texts, size = [], [], 0
    for r in kept.toLocalIterator():
        if size + len(r.text) > BLOCK_BYTES and ids:
            yield sc.broadcast(Items(pa.array(ids, kind), texts))
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield sc.broadcast(Items(pa.array(ids, kind), texts))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): every passage that aligns with a test item; ids of any type.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z;
    positions count them from 0.  Null and empty texts have no passages; equal
    rows and equal items give a row each.
    """
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, first_word long, end_word long"
    out = None
    for block in _blocks(benchmark):
        def run(piece: pa.RecordBatch, block=block) -> pa.RecordBatch:
            found = block.value.leaks(piece.column("text"))
            rows = [(d, *span) for d, spans in enumerate(found) for span in spans]
            d, k, score, first, end = (pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())))
            return pa.RecordBatch.from_arrays([piece.column("doc_id").take(d), block.value.ids.take(k), score, first, end], ["doc_id", "item_id", "score", "first_word", "end_word"])

        part = docs.select("doc_id", "text").mapInArrow(map_pieces(run), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no passage of the benchmark.

    After the first block, a pass reads the rows that the one before left, from
    the shared folder; so a worker holds one block, however many there are.
    """
    staging = None
    for block in _blocks(benchmark):
        def run(piece: pa.RecordBatch, block=block) -> pa.RecordBatch:
            return piece.filter(pa.array([not x for x in block.value.leaks(piece.column("text"))], pa.bool_()))

        if staging is None:
            staging = Staging(docs.sparkSession)
        else:
            docs = staging.put(docs)
            staging.drop_others(docs)
        docs = docs.mapInArrow(map_pieces(run), docs.schema)
    return docs
