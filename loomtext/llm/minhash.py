"""Operator 6, near-duplicate groups by min-max hashing.

Both the minimum and the maximum under each permutation enter the signature,
so half as many hash evaluations fill the bands.  Bands give candidates; every
link is confirmed on the full shingle sets with exact integers.

Texts with equal shingle sets are one node from the start, so exact copies
never meet in a bucket.  A bucket of distinct texts is not expanded into its
pairs:

1. each bucket compares its members with one centre (a member drawn by hash, a
   different one in each band); confirmed links give first components;
2. buckets whose members still lie in several components give the remaining
   pairs between components: small ones directly, large ones through a prefix
   filter over rarest-first shingles, which no two texts above the threshold
   can evade.

Pairs inside one component need no check for the result.  With 48 bands of 8
values a pair at 0.85 shares no band with probability 2e-7, with 40 bands of 6
a pair at 0.8 with probability 5e-6; every pair that shares one is decided
exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.common import Staging, map_pieces
from loomtext.llm.components import components
from loomtext.llm.textvec import hash_words, mix, shingle_set

#: Buckets up to this many members give their open pairs directly (28 pairs at most).
SMALL = 8
#: Bits of a set's bitmap.
BITS = 2048
#: Candidate ids, hashed to 8 bytes, up to this many are broadcast (16 MB); beyond, a shuffled semi-join is used.
BROADCAST_IDS = 1_000_000
#: Groups of equal texts that may count as large: these are broadcast, all others have fewer rows than the total over this.
LARGE_GROUPS = 100_000
#: Texts that share a prefix shingle are met in cells of about this many a side.
CELL = 1024


class MinMax:
    """Min-max signatures of ``bands`` bands with ``rows`` values each, rows / 2 from either end."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        if rows % 2:
            raise ValueError("a band takes as many minima as maxima")
        rng = np.random.default_rng(seed)
        n = bands * rows // 2
        self.bands, self.half = bands, rows // 2
        self.mul = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.add = rng.integers(0, 2**32, n, dtype=np.uint32)
        self.weight = rng.integers(0, 2**63, rows, dtype=np.uint64) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Minima and maxima over a non-empty set, one hash evaluation for both."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.mul), 2**32 - 1, np.uint32)
        high = np.zeros(len(self.mul), np.uint32)
        for at in range(0, len(x), 256):
            v = x[at : at + 256, None] * self.mul
            v += self.add
            np.minimum(low, v.min(0), out=low)
            np.maximum(high, v.max(0), out=high)
        return low, high

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key a band; keys of different bands differ."""
        low, high = self.signature(shingles)
        sides = np.concatenate((low.reshape(self.bands, self.half), high.reshape(self.bands, self.half)), axis=1).astype(np.uint64)
        return mix((sides * self.weight).sum(1, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _features(n: int, minmax: MinMax):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = hash_words(piece.column("text"))
        size, d1, d2, keys = [], [], [], []
        for d in range(piece.num_rows):
            s = shingle_set(words.of(d), n)
            size.append(len(s))
            d1.append(s.sum(dtype=np.uint64))
            d2.append(mix(s).sum(dtype=np.uint64))
            keys.append(minmax.keys(s) if len(s) else np.zeros(0, np.uint64))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(size, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)), pa.array(np.array(d2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64)))],
            ["doc_id", "n", "d1", "d2", "keys"],
        )

    return map_pieces(run)


def _sets(n: int):
    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = hash_words(piece.column("text"))
        sets = [shingle_set(words.of(d), n) for d in range(piece.num_rows)]
        d1, d2 = (pa.array(np.array([f(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for f in (lambda s: s, mix))
        offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        marks = np.zeros((len(sets), BITS), bool)
        for row, s in zip(marks, sets):
            row[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
        bits = pa.array(list(np.packbits(marks, axis=1).view(np.int64)), pa.list_(pa.int64()))
        flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
        return pa.RecordBatch.from_arrays([d1, d2, flat, bits], ["d1", "d2", "set", "bits"])

    return map_pieces(run)


def _fits(a: str, b: str, percent: int):
    """Whether two set sizes allow the threshold."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("inter"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return both.filter(F.expr(f"100 * inter >= {percent} * (total - inter)")).select("a", "b")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among ``members`` (node, n, label) that share a rare shingle.

    Shingles are ordered rarest first; of two sets above the threshold, each
    has a common shingle among its n - ceil(percent * n / 100) + 1 first ones.
    Two bounds inside the join keep copies of one text that were edited too
    much to be linked from being paired.  Shingles that no other component has
    cannot be common, which leaves ``most``; and a shingle whose bit the other
    set's bitmap lacks is not in it.
    """
    tokens = members.join(sets, "node").select("node", "n", "label", F.explode("set").alias("t"))
    often = tokens.groupBy("t").agg(F.count("*").alias("df"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    by_node = Window.partitionBy("node")
    kept = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    known = tokens.join(often, "t").withColumn("r", F.row_number().over(by_node.orderBy("df", "t"))).withColumn("most", F.col("n") - F.count(F.when(F.col("lo") == F.col("hi"), 1)).over(by_node))
    heads = known.filter((F.col("r") <= kept) & (F.col("lo") != F.col("hi")) & (100 * F.col("most") >= percent * F.col("n"))).select("t", "node", "n", "label", "most", F.ceil(F.col("df") / CELL).alias("cells"))
    # a frequent shingle's texts are dealt to cells; each pair meets in the cell of its two sides
    heads = heads.join(sets.select("node", "bits"), "node").withColumn("own", F.pmod(F.xxhash64("node"), "cells"))
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    other = heads.select("t", every.alias("i"), F.col("own").alias("j"), *(F.col(c).alias(f"{c}2") for c in ("node", "n", "label", "most", "bits")))
    heads = heads.select("t", F.col("own").alias("i"), every.alias("j"), "node", "n", "label", "most", "bits")

    def lacks(x: str, y: str) -> str:
        return " + ".join(f"bit_count({x}[{k}] & ~{y}[{k}])" for k in range(BITS // 64))

    # common / (n + n2 - common) >= percent / 100, for the most that can be common
    enough = lambda common: F.expr(f"{100 + percent} * ({common}) >= {percent} * (n + n2)")
    possible = enough("least(most, most2)") & enough(f"n - ({lacks('bits', 'bits2')})") & enough(f"n2 - ({lacks('bits2', 'bits')})")
    return heads.join(other, (heads["t"] == other["t"]) & (heads["i"] == other["i"]) & (heads["j"] == other["j"]) & (F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2")) & possible).select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id of any ordered type, text; other columns are ignored).

    Empty or null texts have no shingles and are linked with nothing.  Rows
    that share a doc_id are one document, linked by each of its texts; n_shingles
    is the row's own.  A row without doc_id is linked with nothing: component_id
    is null and kept is true.  Ties cannot occur: the smallest doc_id of a
    component stays.
    """
    staging = Staging(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    feats = staging.put(slim.mapInArrow(_features(shingle, MinMax(bands, rows)), f"doc_id {kind}, n long, d1 long, d2 long, keys array<long>"))
    some = feats.filter("n > 0 and doc_id is not null")
    sets_of = some.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = staging.put(sets_of.withColumn("node", F.monotonically_increasing_id()))
    narrow = staging.put(feats.select("doc_id", "n", "d1", "d2"))
    staging.drop(feats)

    flat = nodes.select(F.explode("keys").alias("key"), "node", "n")
    drawn = F.xxhash64("node", "key")
    stats = flat.groupBy("key").agg(F.count("*").alias("c"), F.min_by(F.struct("node", "n"), drawn).alias("centre")).filter("c > 1")
    members = staging.put(flat.join(stats, "key").select("key", "c", "node", "n", F.col("centre.node").alias("centre"), F.col("centre.n").alias("centre_n")))
    own = staging.put(_several_texts(narrow, nodes))
    same = own.join(own.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("a < node").select("a", F.col("node").alias("b"))
    if members.isEmpty():
        comps = components(same, staging)
    else:
        sets = staging.put(_candidate_sets(slim, nodes, members, shingle))
        stars = members.filter((F.col("node") != F.col("centre")) & _fits("n", "centre_n", percent))
        pairs = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        edges = staging.put(_linked(pairs, sets, percent).union(same))
        comps = components(edges, staging)
        more = staging.put(_open_pairs(members, comps, sets, staging, percent))
        if not more.isEmpty():
            found = staging.put(_linked(more, sets, percent))
            if not found.isEmpty():
                comps = components(edges.union(found), staging)
    low = comps.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("low"))
    named = nodes.join(comps.join(low, "label").select("node", "low"), "node", "left").select("node", "d1", "d2", "c", F.coalesce("low", "least").alias("component_id"))
    named = staging.put(named)
    of_doc = staging.put(own.join(named.select("node", "component_id"), "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    staging.drop_others(narrow, named, of_doc)
    return _told(narrow, named, of_doc)


def _several_texts(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, node) of the documents whose rows have different shingle sets, empty ones included."""
    known = rows.filter("doc_id is not null").select("doc_id", F.struct("d1", "d2").alias("mark"))
    several = known.groupBy("doc_id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("lo <> hi").select("doc_id")
    return rows.join(several, "doc_id", "left_semi").filter("n > 0").select("doc_id", "d1", "d2").distinct().join(nodes.select("d1", "d2", "node"), ["d1", "d2"]).select("doc_id", "node")


def _candidate_sets(slim: DataFrame, nodes: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(node, set, bits) of the nodes in buckets, from the texts of their documents."""
    asked = nodes.join(members.select("node").distinct(), "node", "left_semi").select("d1", "d2", "node", F.xxhash64("least").alias("h"))
    ids = asked.select("h").distinct()
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = slim.join(few, F.xxhash64(slim["doc_id"]) == few["h"], "left_semi")
    sets = texts.mapInArrow(_sets(shingle), "d1 long, d2 long, set array<long>, bits array<long>").groupBy("d1", "d2").agg(F.first("set").alias("set"), F.first("bits").alias("bits"))
    return sets.join(asked.select("d1", "d2", "node"), ["d1", "d2"]).select("node", "set", "bits")


def _told(rows: DataFrame, named: DataFrame, of_doc: DataFrame) -> DataFrame:
    """Each row's result.

    Large groups of equal texts are few, so their results are broadcast and
    their rows stay where they are; all other rows meet theirs by a join whose
    groups are bounded; rows without words take part in neither.
    """
    total = named.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    large = named.filter(F.col("c") >= max(1000, total // LARGE_GROUPS)).select("d1", "d2", "component_id")
    small = named.filter(F.col("c") < max(1000, total // LARGE_GROUPS)).select("d1", "d2", "component_id")
    worded = rows.filter("n > 0 and doc_id is not null")
    hot = worded.join(F.broadcast(large), ["d1", "d2"])
    rest = worded.join(F.broadcast(large.select("d1", "d2")), ["d1", "d2"], "left_anti").join(small, ["d1", "d2"])
    bare = rows.filter("n = 0 or doc_id is null").join(of_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = None
    for part in (hot, rest, bare):
        part = part.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        out = part if out is None else out.union(part)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _open_pairs(members: DataFrame, comps: DataFrame, sets: DataFrame, staging: Staging, percent: int) -> DataFrame:
    """The pairs in buckets that still lie in different components."""
    marked = members.filter("c > 2").select("key", "c", "node", "n", "centre").join(comps, "node", "left").withColumn("label", F.coalesce("label", "node"))
    marked = staging.put(marked)
    split = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    open_ = staging.put(marked.join(split, "key"))
    small = open_.filter((F.col("c") <= SMALL) & (F.col("node") != F.col("centre"))).groupBy("key").agg(F.collect_list(F.struct("node", "n", "label")).alias("m"))
    direct = small.select(F.explode(F.expr("flatten(transform(m, x -> transform(filter(m, y -> x.node < y.node and x.label <> y.label), y -> struct(x.node as a, y.node as b, x.n as na, y.n as nb))))")).alias("p")).select("p.*").filter(_fits("na", "nb", percent)).select("a", "b").distinct()
    large = open_.filter(F.col("c") > SMALL).select("node", "n", "label").distinct()
    staging.drop(marked)
    return direct.union(_prefix_pairs(large, sets, percent)).distinct()
