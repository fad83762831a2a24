"""Texts as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import text as T


def explode_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line) of (file, content); line_no from 0, terminators kept, empty and null files have no rows."""
    return files.select("file", F.posexplode(T.split_lines("content")).alias("line_no", "line")).select("file", F.col("line_no").cast("long").alias("line_no"), "line")


def join_files(pieces: DataFrame) -> DataFrame:
    """(file, line_no, line) of (file, seq, content): the pieces of a file one after the other, each ended by a newline.

    Line numbers come from prefix sums over pieces, not lines, so a file of
    many pieces sorts one narrow row for each of them.  A null file is a file
    of its own, a null seq comes first, null contents have no lines.  Pieces
    with one file and seq share a place: their lines count from the same number
    and the next piece begins after the longest.
    """
    sizes = pieces.filter("content is not null").groupBy(F.col("file").alias("f"), F.col("seq").alias("s")).agg(F.max(T.count_newlines("content") + 1).alias("n"))
    before = Window.partitionBy("f").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("f", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = pieces.join(starts, pieces["file"].eqNullSafe(starts["f"]) & pieces["seq"].eqNullSafe(starts["s"]))
    lines = placed.select(pieces["file"], starts["start"], F.posexplode(T.split_lines(F.concat(pieces["content"], F.lit("\n")))).alias("at", "line"))
    return lines.select("file", (F.col("start") + F.col("at")).alias("line_no"), "line")


def line_statistics(lines: DataFrame) -> DataFrame:
    """``lines`` with n_words, n_bytes and blank; a null line has no words and is not known to be blank."""
    return lines.withColumns({"n_words": T.count_words("line"), "n_bytes": T.count_bytes("line"), "blank": T.is_blank("line")})
