"""Whole conversions: a path in, files out."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.jsontext import json_leaves
from loomtext.operators import chat, split
from loomtext.sources import epub, files
from loomtext.sources.parts import BOM, write_parts

#: Words of a part where no limit is given, for splits and for chats.
DEFAULT_WORDS = 50_000


def split_path(spark: SparkSession, path: str, folder: str, method: str, value, delimiters: list[str] | None = None) -> DataFrame:
    """Splits a file, or each file of a directory, and writes ``{stem}_part_{n}{extension}``; returns the parts.

    Malformed UTF-8 raises; an empty file gives no parts.
    """
    lines = files.read_lines(spark, path)
    if method == "words":
        parts = split.by_words_at_delimiters(lines, value, delimiters)
    else:
        parts = split.METHODS[method](lines, value)
    write_parts(parts.select(T.part_name(T.base_name("file"), "part_no").alias("name"), "line_no", "line"), folder)
    return parts


def _named(found: DataFrame, source: str, name: str | None) -> DataFrame:
    """``found`` with its target's name: that of the source file with ``.txt``, or ``name`` for one source only."""
    if name is None:
        return found.withColumn("name", T.text_name(source))
    if found.select(source).limit(2).count() > 1:
        raise ValueError(f"{name} can hold one document only")
    return found.withColumn("name", F.lit(name))


def convert_json(spark: SparkSession, path: str, folder: str, name: str | None = None) -> None:
    """String leaves of each document, one a line, no newline at the end; ``name``: the text file of a single one."""
    found = _named(files.read_json_documents(spark, path), "name", name)
    write_parts(found.select("name", F.lit(0).alias("line_no"), F.array_join(json_leaves("content"), "\n").alias("line")), folder)


def convert_epub(spark: SparkSession, path: str, folder: str, name: str | None = None, bare: bool = True) -> None:
    """The text of each book, named after it; ``name``: the text file of a single one; ``bare`` is that of ``markup.to_text``."""
    books = _named(files.read_bytes(spark, path).withColumn("book", F.col("name")), "book", name).select(F.col("name").alias("file"), "content")
    write_parts(epub.to_documents(books, bare=bare).select(F.col("file").alias("name"), F.lit(0).alias("line_no"), F.col("content").alias("line")), folder)


def convert_chat(spark: SparkSession, path: str, folder: str, limit: int = DEFAULT_WORDS, base: str = "chat_part") -> int:
    """An export's messages as ``{base}_{n}.txt``; part 1 is there even if it is empty.  Returns how many parts there are.

    Pages are parsed once: messages, then their parts, wait in the target
    folder, hidden, and go at the end.
    """
    pages = files.read_chat_files(spark, path).withColumn("export", F.lit(os.path.normpath(path)))
    held = f"{os.path.abspath(folder)}/.loomchat-{uuid.uuid4().hex}"
    os.makedirs(held)

    def hold(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(at := f"file://{held}/{name}")
        return spark.read.schema(df.schema).parquet(at)

    try:
        messages = hold(chat.extract_messages(pages, ("export", "name", "file_no")), "messages")
        found = chat.order_export(messages).withColumn("file", F.col("export"))
        parts = hold(chat.transcript(chat.cut_by_words(found, limit)).select("file", "part_no", "line_no", "entry"), "parts")
        named = parts.select(F.concat(F.lit(f"{base}_"), "part_no", F.lit(".txt")).alias("name"), "line_no", F.col("entry").alias("line"))
        if parts.filter("part_no = 1").isEmpty():
            named = named.union(spark.sql(f"select '{base}_1.txt' as name, -1L as line_no, cast(null as string) as line"))
        write_parts(named, folder, BOM)
        return max((r.parts for r in chat.count_parts(parts).collect()), default=1)  # one row: a path is one export
    finally:
        shutil.rmtree(held, ignore_errors=True)
