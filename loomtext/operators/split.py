"""Cutting ordered lines into parts.

Each operator takes (file, line_no, line) and adds ``part_no``; no line is ever
cut, so the parts in order give the file back.  Cuts by count and into equal
parts are arithmetic; cuts at delimiters are windows.  Cuts by weight depend on
where the part before ended, so they walk along a file with a constant state,
by prefix sums, one step for each part.

Whatever is sorted by file is narrow, (file, place, weight, hit), without text.
Parts come back to the lines as runs, one row for each part in each block of
``BLOCK`` lines, joined by block; so a huge file's lines stay spread over its
blocks, and runs are broadcast while they are small.

Every input row gives one row.  A null file is a file of its own, a null line
number counts as 0, a null line has no words or bytes; rows with one file and
line number share a place, whose weights add up, and so a part.  Columns that
have the name of a result are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from loomtext.functions import text as T

#: Lines of a block, the unit in which parts are joined to lines; a power of two.
BLOCK = 64


def _place(line_no: Column | str = "line_no") -> Column:
    return F.coalesce(F.col(line_no) if isinstance(line_no, str) else line_no, F.lit(0)).cast("long")


def _block(place: Column) -> Column:
    return F.shiftright(place, BLOCK.bit_length() - 1)


def _adding(lines: DataFrame, name: str, value: Column) -> list[Column]:
    return [*(lines[c] for c in lines.columns if c != name), value.alias(name)]


def by_lines(lines: DataFrame, limit: int) -> DataFrame:
    """``limit`` lines a part; less than one counts as one."""
    return lines.select(*_adding(lines, "part_no", F.floor(_place() / max(limit, 1)).cast("long") + 1))


def by_parts(lines: DataFrame, parts: int) -> DataFrame:
    """At most ``parts`` parts of equally many lines, the last one shorter; none for parts < 1."""
    if parts < 1:
        return lines.select(*_adding(lines, "part_no", F.lit(0).cast("long"))).filter(F.lit(False))
    each = lines.groupBy(F.col("file").alias("f")).agg(T.ceil_div(F.max(_place()) + 1, parts).alias("each"))
    sized = lines.join(each, lines["file"].eqNullSafe(each["f"]))
    return sized.select(*_adding(lines, "part_no", F.floor(_place(lines["line_no"]) / each["each"]).cast("long") + 1))


def _places(lines: DataFrame, weight: Column, hit: Column | None = None) -> DataFrame:
    """(f, p, w, hit): one row for each place, a file's places in one partition."""
    hit = F.lit(False) if hit is None else F.coalesce(hit, F.lit(False))
    narrow = lines.select(F.col("file").alias("f"), _place().alias("p"), F.coalesce(weight, F.lit(0)).cast("long").alias("w"), hit.alias("hit"))
    return narrow.repartition("f").groupBy("f", "p").agg(F.sum("w").alias("w"), F.max("hit").alias("hit"))


def _attach(lines: DataFrame, numbered: DataFrame) -> DataFrame:
    """``lines`` with the part numbers of ``numbered`` (f, p, part), in which parts do not go back along a file."""
    runs = numbered.groupBy("f", _block(F.col("p")).alias("b"), "part").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    place = _place(lines["line_no"])
    own = lines["file"].eqNullSafe(runs["f"]) & (_block(place) == runs["b"]) & place.between(runs["lo"], runs["hi"])
    return lines.join(runs, own).select(*_adding(lines, "part_no", runs["part"]))


@dataclass
class State:
    """Where a walk along a file stands: its part, that part's weight, and whether it has a line."""

    file: object
    part: int = 1
    total: int = 0
    held: bool = False


#: Part numbers of a file's next places, from their weights and hits; the state moves on.
Number = Callable[[State, np.ndarray, np.ndarray], np.ndarray]


def _numbering(next_cut: Callable[[np.ndarray, np.ndarray, np.ndarray, int, int], int], lone: bool = False) -> Number:
    """A walk by prefix sums.

    ``next_cut(upto, w, hits, base, i)`` is the first index from i on at which
    a part begins, where ``base`` was the sum when the part before began; hits
    are indices.  ``lone``: a first place may end a part that is still empty.
    """

    def number(s: State, w: np.ndarray, hit: np.ndarray) -> np.ndarray:
        upto, hits = s.total + np.cumsum(w), np.flatnonzero(hit)
        cuts, base, i = [], 0, 0 if s.held or lone else 1
        while i < len(w) and (k := next_cut(upto, w, hits, base, i)) < len(w):
            cuts.append(k)
            base, i = int(upto[k] - w[k]), k + 1
        marks = np.zeros(len(w), np.int64)
        marks[cuts] = 1
        out = s.part + np.cumsum(marks)
        s.part, s.total, s.held = int(out[-1]), int(upto[-1]) - base, True
        return out

    return number


def _greedy(limit: int, lone: bool = False) -> Number:
    """A part takes places while they fit; one above the limit stands alone."""
    return _numbering(lambda upto, w, hits, base, i: max(i, int(np.searchsorted(upto, base + limit, "right"))), lone)


def _at_hits(limit: int) -> Number:
    """A part ends at the first hit after it has the limit."""

    def next_cut(upto, w, hits, base, i):
        k = max(i, int(np.searchsorted(upto - w, base + limit, "left")))
        at = int(np.searchsorted(hits, k))
        return int(hits[at]) if at < len(hits) else len(w)

    return _numbering(next_cut)


def _walk(places: DataFrame, number: Number) -> DataFrame:
    """(f, p, part) of places that are sorted within their files here and streamed."""
    kind = places.schema["f"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            file = b.column("f")
            code = np.asarray(file.dictionary_encode().indices.fill_null(-1))
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            w, hit, out = np.asarray(b.column("w")), b.column("hit").to_numpy(zero_copy_only=False), np.zeros(len(code), np.int64)
            for a, z in zip(edges, edges[1:]):
                if a < z and (state is None or file[a].as_py() != state.file):
                    state = State(file[a].as_py())
                if a < z:
                    out[a:z] = number(state, w[a:z], hit[a:z])
            yield pa.RecordBatch.from_arrays([file, b.column("p"), pa.array(out)], ["f", "p", "part"])

    return places.sortWithinPartitions("f", "p").select("f", "p", "w", "hit").mapInArrow(run, f"f {kind}, p long, part long")


def by_weight(lines: DataFrame, weight: Column, limit: int, lone: bool = False) -> DataFrame:
    """As many lines as ``limit`` holds; ``lone``: a first line above the limit leaves part 1 without lines."""
    return _attach(lines, _walk(_places(lines, weight), _greedy(limit, lone)))


def by_bytes(lines: DataFrame, limit: int) -> DataFrame:
    """As many lines as ``limit`` UTF-8 bytes hold, terminators counted."""
    return by_weight(lines, T.count_bytes("line"), limit)


def by_words(lines: DataFrame, limit: int) -> DataFrame:
    """As many lines as ``limit`` words hold."""
    return by_weight(lines, T.count_words("line"), limit)


def _along() -> WindowSpec:
    return Window.partitionBy("f").orderBy("p")


def _starts(lines: DataFrame, delimiters: list[str]) -> DataFrame:
    """(f, p, w, hit, starts): starts where a hit's previous place with words is none."""
    places = _places(lines, T.count_words("line"), T.contains_any("line", delimiters))
    known = F.last(F.when(F.col("w") > 0, F.col("hit")), ignorenulls=True).over(_along().rowsBetween(Window.unboundedPreceding, -1))
    return places.withColumn("starts", F.col("hit") & ~F.coalesce(known, F.lit(False)))


def mark_sections(lines: DataFrame, delimiters: list[str]) -> DataFrame:
    """``lines`` with starts: a delimiter line whose previous non-blank line is none."""
    first = _starts(lines, delimiters).filter("starts").select("f", "p", "starts")
    marked = lines.join(first, lines["file"].eqNullSafe(first["f"]) & (_place(lines["line_no"]) == first["p"]), "left")
    return marked.select(*_adding(lines, "starts", F.coalesce(first["starts"], F.lit(False))))


def by_words_at_delimiters(lines: DataFrame, limit: int, delimiters: list[str] | None) -> DataFrame:
    """Cuts only where a section starts and the part has ``limit`` words already; by words if no delimiter is set."""
    if not delimiters:
        return by_words(lines, limit)
    places = _starts(lines, delimiters).select("f", "p", "w", F.col("starts").alias("hit"))
    return _attach(lines, _walk(places, _at_hits(limit)))


def by_delimiter(lines: DataFrame, delimiters: list[str] | str) -> DataFrame:
    """A part for each section.

    Lines before the first section are part 0, and sections then count from 2;
    without such lines they count from 1.  A file without delimiters is part 1.
    """
    delimiters = [delimiters] if isinstance(delimiters, str) else delimiters
    counted = _starts(lines, delimiters).withColumn("s", F.sum(F.col("starts").cast("long")).over(_along()))
    whole = _along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = counted.withColumns({"cut": F.max("starts").over(whole), "head": F.first("starts").over(whole)})
    part = F.when(~F.col("cut"), F.lit(1)).when(F.col("head"), F.col("s")).when(F.col("s") == 0, F.lit(0)).otherwise(F.col("s") + 1)
    return _attach(lines, told.select("f", "p", part.cast("long").alias("part")))


def roll_up(parts: DataFrame) -> DataFrame:
    """(file, part_no, n_lines, n_words, n_bytes, content): one row for each part, lines in order.

    Lines that share a place come in the order of their text.  A part is one
    value here; to write parts of any size use the sink, which streams lines.
    """
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "")
    return parts.groupBy("file", "part_no").agg(F.count("*").alias("n_lines"), F.sum(T.count_words("line")).alias("n_words"), F.coalesce(F.sum(T.count_bytes("line")), F.lit(0)).alias("n_bytes"), content.alias("content"))


#: Method names, in the order in which options take precedence.
METHODS = {
    "lines": by_lines,
    "bytes": by_bytes,
    "parts": by_parts,
    "words": by_words,
    "delimiter": by_delimiter,
}
