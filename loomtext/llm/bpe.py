"""Operator 5, byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves every pre-token
that is itself an entry, with one probe and one comparison.  Tier two: any
other pre-token is merged by a heap of ranked pairs over a doubly linked list
of its bytes, O(n log n) however long it is.

A worker keeps the results of recent pre-tokens in two generations of ``MEMO``
each: when the young one is full it becomes the old one, and what is asked for
again moves back, so frequent words stay.  Nothing else grows with the corpus.
The driver reads the rank file once and ships its bytes with the task, so
executors need no copy of it; a worker parses them once.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from loomtext.llm.common import map_texts

#: Pre-tokens in a generation of a worker's memory (about 250 bytes each).
MEMO = 150_000

_U = np.uint64
_STEP, _SPREAD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_ALL = (1 << 64) - 1


class PerfectHash:
    """Maps each of n byte strings to its own number below n; displaced buckets, no empty slot."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        n = self.n = len(keys)
        self.m = max(1, n // per_bucket)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], _U)
        if len(np.unique(h)) != n:
            raise ValueError("keys repeat or their hashes do")
        shift = np.zeros(self.m, np.int64)
        slot = np.full(n, -1, np.int64)
        bucket = (h % _U(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.m)
        first = np.concatenate(([0], np.cumsum(sizes)))
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[first[b] : first[b + 1]]
            if len(own) < 2:
                break
            shift[b] = self._displace(h[own], own, slot)
        free = np.flatnonzero(slot < 0).tolist()
        for b in np.flatnonzero(sizes == 1).tolist():
            at = free.pop()
            slot[at] = order[first[b]]
            shift[b] = -at - 1
        self.shift, self.key_at = shift.tolist(), slot.tolist()

    def _displace(self, h: np.ndarray, own: np.ndarray, slot: np.ndarray) -> int:
        for at in range(0, 1 << 24, 256):
            d = np.arange(at, at + 256, dtype=_U)[:, None]
            where = (((h[None, :] ^ (d * _U(_STEP))) * _U(_SPREAD)) >> _U(32)) % _U(self.n)
            good = (slot[where.astype(np.int64)] < 0).all(1)
            for k in np.flatnonzero(good).tolist():
                if len(set(where[k].tolist())) == len(own):
                    slot[where[k].astype(np.int64)] = own
                    return at + k
        raise ValueError("no displacement found")

    def probe(self, key: bytes) -> int:
        """The only number the key can have; the caller compares."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        if d < 0:
            return self.key_at[-d - 1]
        return self.key_at[((((h ^ (d * _STEP & _ALL)) * _SPREAD) & _ALL) >> 32) % self.n]


def parse_ranks(lines: Iterable[bytes]) -> list[tuple[bytes, int]]:
    return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, lines)]


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return parse_ranks(f)


class Codec(dict):
    """Encoder and decoder; as a dict, the memo from a pre-token to its ids in decimal, blank between."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        super().__init__()
        self.tokens = [t for t, _ in ranks]
        self.ids = [r for _, r in ranks]
        self.rank = dict(ranks)
        self.hash = PerfectHash(self.tokens)
        self.split = regex.compile(pattern).findall
        self.old: dict[str, str] = {}

    @functools.cached_property
    def by_decimal(self) -> dict[str, bytes]:
        return {str(r): t for t, r in zip(self.tokens, self.ids)}

    def __missing__(self, piece: str) -> str:
        out = self.old.get(piece)
        if out is None:
            raw = piece.encode()
            at = self.hash.probe(raw)
            out = str(self.ids[at]) if self.tokens[at] == raw else " ".join(map(str, self.merge(raw)))
        if len(piece) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals."""
        n, rank = len(raw), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [rank.get(raw[i : i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if pair[i] != r:
                continue
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = i
                pair[i] = new = rank.get(raw[i : after[end]], -1)
                if new >= 0:
                    heapq.heappush(heap, new * n + i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                pair[p] = new = rank.get(raw[p:end], -1)
                if new >= 0:
                    heapq.heappush(heap, new * n + p)
        out, i = [], 0
        while i < n:
            out.append(rank[raw[i : after[i]]])
            i = after[i]
        return out

    def decimals(self, text: str) -> str:
        """The ids of a text in decimal, one space between."""
        return " ".join(map(self.__getitem__, self.split(text)))

    def array(self, text: str) -> np.ndarray:
        """The ids of a text, four bytes each."""
        decimals = self.decimals(text)
        return np.fromstring(decimals, np.int32, sep=" ") if decimals else np.zeros(0, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.array(text).tolist()

    def decode(self, decimals: str) -> bytes:
        return b"".join(map(self.by_decimal.__getitem__, decimals.split()))


_codecs: dict[bytes, Codec] = {}


class _Shipped:
    """What travels with a task: the rank file's bytes; a worker builds its codec once."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.raw, self.pattern = f.read(), pattern
        self.key = hashlib.sha256(repr((self.raw, pattern)).encode()).digest()

    def ranks(self) -> list[tuple[bytes, int]]:
        return parse_ranks(self.raw.splitlines())

    def codec(self) -> Codec:
        if self.key not in _codecs:
            _codecs[self.key] = Codec(self.ranks(), self.pattern)
        return _codecs[self.key]


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens and ids (array of int) of every text, in the rank file's ids.

    Null and empty texts have no ids.  Special tokens have no meaning: their
    strings are ordinary text.  Rows may repeat; each is encoded.
    """
    shipped = _Shipped(path, pattern)

    def batches(it):
        codec = shipped.codec()

        def one(text: str):
            ids = codec.array(text)
            return len(ids), ids

        yield from map_texts(one, ["n_tokens", "ids"], [pa.int64(), pa.list_(pa.int32())], list(keep))(it)

    kept = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    return kept.mapInArrow(batches, f"{fields}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the bytes that ``ids`` stand for; null ids count as none."""
    shipped = _Shipped(path, "")

    def batches(it):
        token = {r: t for t, r in shipped.ranks()}
        for b in it:
            out = [b"".join(map(token.__getitem__, ids or ())) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.binary())], [*keep, "decoded"])

    kept = encoded.select(*keep, "ids")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    return kept.mapInArrow(batches, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and its ids decoded again, in one pass."""
    shipped = _Shipped(path, pattern)

    def batches(it):
        codec = shipped.codec()

        def one(text: str):
            ids = codec.decimals(text)
            return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

        yield from map_texts(one, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], ["doc_id"])(it)

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
