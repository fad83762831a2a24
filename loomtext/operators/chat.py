"""Chat exports to transcripts in word-limited parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.functions import chatpage
from loomtext.functions import text as T
from loomtext.operators.split import by_weight


def extract_messages(pages: DataFrame, keep: tuple[str, ...] = ("file",)) -> DataFrame:
    """``keep``, msg_no, date, sender and text of (content, ...) pages, msg_no from 0 within a page."""
    kept = pages.select(*keep, "content")
    fields = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, page in enumerate(b.column("content").to_pylist()):
                found = chatpage.messages(page or "")
                if found:
                    row = [b.column(k).take(pa.array([i] * len(found))) for k in keep]
                    yield pa.RecordBatch.from_arrays([*row, pa.array(range(len(found)), pa.int64()), *(pa.array(c, pa.string()) for c in zip(*found))], [*keep, "msg_no", "date", "sender", "text"])

    return kept.mapInArrow(run, f"{fields}, msg_no long, date string, sender string, text string")


def order_export(messages: DataFrame) -> DataFrame:
    """``messages`` (export, file_no, name, msg_no, ...) with line_no: their place in the export.

    Files order by number, then name; offsets are prefix sums over files.
    """
    files = messages.groupBy("export", "file_no", "name").agg(F.max("msg_no").alias("last"))
    before = Window.partitionBy("export").orderBy("file_no", "name").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("export", "name", F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("start"))
    return messages.join(starts, ["export", "name"]).withColumn("line_no", F.col("start") + F.col("msg_no")).drop("start")


def transcript(messages: DataFrame) -> DataFrame:
    """``messages`` with entry: one line for the message and a rule."""
    head = F.concat(F.lit("["), F.coalesce("date", F.lit("?")), F.lit("] "), F.coalesce("sender", F.lit("System")), F.lit(": "))
    return messages.withColumn("entry", F.concat(head, T.clean("text"), F.lit("\n"), F.repeat(F.lit("-"), F.lit(20)), F.lit("\n")))


def cut_by_words(messages: DataFrame, limit: int) -> DataFrame:
    """``messages`` (file, line_no, text) with part_no; only words of ``text`` count.

    A part ends when the next message would exceed the limit, even if it is
    still empty: a first message above the limit leaves part 1 without rows,
    which the writer creates all the same.
    """
    return by_weight(messages, T.count_words("text"), limit, lone=True)


def count_parts(parts: DataFrame) -> DataFrame:
    """(file, parts): how many parts each export has, an empty first one included."""
    return parts.groupBy("file").agg(F.max("part_no").alias("parts"))
