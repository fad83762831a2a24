"""Operator 9, quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts are computed on Arrow buffers with numpy.  The trees
are trained here, by second-order boosting over binned features with monotonic
constraints, on at most ``SAMPLE`` labelled rows drawn by a hash of their id;
they are flattened into node arrays, so a batch is scored by one gather for
each level of all trees together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import map_pieces
from loomtext.llm.textvec import SPACE_BYTES, buffers, hash_words, ngrams

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000

#: Feature and the direction in which the verdict may follow it (0: either).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "digit_share": 0,
    "upper_share": 0,
    "punct_share": 0,
    "mean_line": 0,
    "distinct_share": 0,
    "wide_share": 0,
}

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_LEAD = np.ones(256, np.int64)
_LEAD[0x80:0xC0] = 0


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


_IN_WORD = _LEAD * ~SPACE_BYTES
_SYMBOL, _DIGIT, _UPPER, _PUNCT, _LINE = _lut("#*$%&|<>"), _lut("0123456789"), _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut(".,;:!?"), _lut("\n")


def repeated_words(h: np.ndarray) -> int:
    """Words that lie in a 3-word window found at least twice."""
    g = ngrams(h, 3)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = np.flatnonzero(g[order[1:]] == g[order[:-1]])
    if not len(same):
        return 0
    at = np.concatenate((order[same], order[same + 1]))
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (int) and FEATURES (float) of each text of a column; null counts as empty."""
    raw, offs = buffers(column)
    words = hash_words(column, lower=False)
    n = len(offs) - 1

    def total(weights: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for at in range(0, len(raw), 1 << 17):  # sums by document of one slice at a time
            to = min(len(raw), at + (1 << 17))
            lo, hi = np.searchsorted(offs, at, "right") - 1, np.searchsorted(offs, to, "left")
            edges = np.clip(offs[lo : hi + 1], at, to) - at
            run = np.concatenate(([0], np.cumsum(weights[raw[at:to]])))
            out[lo:hi] += np.diff(run[edges])
        return out

    n_words = np.diff(words.first)
    chars, symbols, digits, upper, punct, points = (total(w) for w in (_IN_WORD, _SYMBOL, _DIGIT, _UPPER, _PUNCT, _LEAD))
    dup, lines, repeat, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    data = raw.tobytes()
    for d in range(n):
        h = words.of(d)
        repeat[d], distinct[d] = repeated_words(h), len(np.unique(h))
        own = [x for x in data[offs[d] : offs[d + 1]].split(b"\n") if x.strip()]
        lines[d], dup[d] = len(own), len(own) - len(set(own))
    counts = np.stack((n_words, chars, symbols, dup, repeat), axis=1)
    c, w, ln = np.maximum(chars, 1), np.maximum(n_words, 1), np.maximum(lines, 1)
    wide = np.diff(offs) - points
    return counts, np.stack((np.log1p(n_words), chars / w, symbols / c, dup / ln, repeat / w, digits / c, upper / c, punct / w, n_words / ln, distinct / w, wide / c), axis=1)


@dataclass
class Trees:
    """Complete binary trees of one depth: node arrays [tree, node] and leaf values [tree, leaf]."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of ``x``."""
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range((self.feature.shape[1] + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        margin = self.base + self.leaf[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Second-order boosting for the logistic loss.

    A split whose children would break a constraint is not taken, and children
    inherit the middle value as a bound, so the whole tree is monotonic in each
    constrained feature.  No labels, or one class only: a constant.
    """
    nodes, leaves = 2**depth - 1, 2**depth
    out = Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)), 0.0)
    if not len(y):
        out.base = 30.0
        return out
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    out.base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), out.base)
    feats, thrs, vals = [], [], []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        feature, threshold, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(leaves)
        todo = [(0, np.arange(len(y)), -np.inf, np.inf)]
        while todo:
            node, rows, lo, hi = todo.pop()
            weight = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi)) if len(rows) else float(np.clip(0, lo, hi))
            if node >= nodes:
                value[node - nodes] = rate * weight
                margin[rows] += rate * weight
                continue
            best = _best_split(binned, g, h, rows, cuts, monotone, lo, hi, ridge)
            if best is None:
                todo += [(2 * node + 1, rows, lo, hi), (2 * node + 2, rows[:0], weight, weight)]
                continue
            f, b, left, right = best
            feature[node], threshold[node] = f, cuts[f][b]
            goes = binned[rows, f] > b
            mid = (left + right) / 2
            bounds = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[int(monotone[f])]
            todo += [(2 * node + 1, rows[~goes], *bounds[0]), (2 * node + 2, rows[goes], *bounds[1])]
        feats.append(feature)
        thrs.append(threshold)
        vals.append(value)
    out.feature, out.threshold, out.leaf = np.array(feats), np.array(thrs), np.array(vals)
    return out


def _best_split(binned, g, h, rows, cuts, monotone, lo, hi, ridge):
    best, gain = None, 1e-6
    if len(rows) < 20:
        return None
    sg, sh = g[rows].sum(), h[rows].sum()
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
        hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
        left, right = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-(sg - gl) / (sh - hl + ridge), lo, hi)
        fall = lambda w, gs, hs: -(gs * w + 0.5 * (hs + ridge) * w * w)
        whole = float(np.clip(-sg / (sh + ridge), lo, hi))
        won = fall(left, gl, hl) + fall(right, sg - gl, sh - hl) - fall(whole, sg, sh)
        won[(hl < 1) | (sh - hl < 1) | ((right - left) * monotone[f] < 0)] = 0
        k = int(won.argmax())
        if won[k] > gain:
            best, gain = (f, k, float(left[k]), float(right[k])), won[k]
    return best


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees fitted on at most ``sample`` labelled documents (labels: doc_id, quality).

    The rows are those whose ids hash lowest, so the choice depends on neither
    order nor partitioning.  Repeated labels of a document vote; a tie is bad
    quality.  Of a repeated id the smallest text counts.  Null ids and labels
    are ignored.
    """
    votes = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("double").alias("y"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def features(piece: pa.RecordBatch) -> pa.RecordBatch:
        _, x = statistics(piece.column("text"))
        return pa.RecordBatch.from_arrays([piece.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = sorted(rows.mapInArrow(map_pieces(features), "y double, x array<double>").collect())
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return train(x, np.array([r.y for r in got]), np.array(list(FEATURES.values())))


def _verdict(counts: np.ndarray, x: np.ndarray, trees: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, score, kept) for each text."""
    p = trees.score(x)
    failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
    return failed, p, ~failed & (p >= 0.5)


def passing(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        return piece.filter(pa.array(_verdict(*statistics(piece.column("text")), trees)[2]))

    return docs.mapInArrow(map_pieces(run), docs.schema)


def score(docs: DataFrame, trees: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, COUNTS, base_failed, kept and score for each row of ``docs``; null text counts as empty."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        counts, x = statistics(piece.column("text"))
        failed, p, kept = _verdict(counts, x, trees)
        cols = [pa.array(np.ascontiguousarray(counts[:, k])) for k in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays([*(piece.column(k) for k in keep), *cols, pa.array(failed), pa.array(kept), pa.array(p)], [*keep, *COUNTS, "base_failed", "kept", "score"])

    own = docs.select(*dict.fromkeys((*keep, "text")))
    fields = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keep)
    return own.mapInArrow(map_pieces(run), f"{fields}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")
