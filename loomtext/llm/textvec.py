"""Vectorised word hashing over Arrow string buffers.

Everything here works on the raw UTF-8 buffer of an Arrow column, so no Python
object is made for a word.  Memory is bounded by ``SEGMENT`` bytes of scratch
plus eight bytes for each word of a batch; a segment is longer only when a
single word is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 16

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)

#: Bytes that end a word: space and \\x09-\\x0D.
SPACE_BYTES = np.zeros(256, dtype=bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that end a word when punctuation is ignored: every ASCII byte that is
#: neither a digit nor a letter.
PUNCT_BYTES = np.zeros(256, dtype=bool)
PUNCT_BYTES[[b for b in range(0x80) if not chr(b).isalnum()]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; one-to-one."""
    h = h ^ (h >> np.uint64(33))
    h = h * _M1
    h = h ^ (h >> np.uint64(29))
    h = h * _M2
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """Hashes of the words of a batch, in order; words of document d are h[first[d]:first[d + 1]]."""

    h: np.ndarray
    first: np.ndarray

    def of(self, d: int) -> np.ndarray:
        return self.h[self.first[d] : self.first[d + 1]]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _segments(raw: np.ndarray, offs: np.ndarray, ends: np.ndarray):
    """Cuts at document starts or between words, about SEGMENT bytes apart."""
    at, n = 0, len(raw)
    while at < n:
        to = min(n, at + SEGMENT)
        while to < n and not ends[raw[to]]:
            near = ends[raw[to : to + 4096]]
            step = int(near.argmax()) if near.any() else len(near)
            stop = to + step
            k = int(np.searchsorted(offs, to))
            to = min(stop, int(offs[k])) if k < len(offs) and offs[k] >= to else stop
            if k < len(offs) and offs[k] == to:
                break
        yield at, to
        at = to


def hash_words(column: pa.Array, ends: np.ndarray = SPACE_BYTES, lower: bool = True) -> Words:
    """64-bit hashes of all words of a column; A-Z count as a-z if ``lower``."""
    raw, offs = buffers(column)
    starts_at, hashes = [], []
    power = np.ones(64, np.uint64)
    for at, to in _segments(raw, offs, ends):
        b = raw[at:to]
        word = ~ends[b]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inner = offs[(offs > at) & (offs < to)] - at if len(offs) < 64 else offs[np.searchsorted(offs, at, "right") : np.searchsorted(offs, to, "left")] - at
        first[inner] |= word[inner]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        w = b[word]
        if lower:
            w = _LOWER[w]
        rank = np.cumsum(word)[starts] - 1
        lens = np.diff(np.append(rank, len(w)))
        longest = int(lens.max())
        if longest > len(power):
            power = np.ones(longest, np.uint64)
        if power[-1] == 1:
            power[1:] = _BASE
            power = np.multiply.accumulate(power)
        pos = np.arange(len(w)) - np.repeat(rank, lens)
        hashes.append(mix(np.add.reduceat(_BYTE[w] * power[pos], rank) + lens.astype(np.uint64)))
        starts_at.append(starts + at)
    if not hashes:
        return Words(np.zeros(0, np.uint64), np.zeros(len(offs), np.int64))
    return Words(np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offs))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words of one text (none if it has fewer)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + h[k : len(h) - n + 1 + k]
    return mix(out)


def shingle_set(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles; a shorter text is one shingle; no words, no shingle."""
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < n:
        return mix(ngrams(h, len(h)) + np.uint64(len(h)))
    s = np.sort(ngrams(h, n))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]
