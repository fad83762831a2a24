"""File scans as DataFrames (file, content).

A missing path raises when the scan is planned; a directory is listed when it
is read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators.lines import explode_lines

#: Names of a batch, bytes after which a batch of contents is sent on, and tasks that a directory's files are dealt to for each core.
LISTED, READ_BYTES, TASKS_A_CORE = 1024, 4 << 20, 3


def read_bytes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, name, content BINARY) of a file, or of the files directly in a directory."""
    if (folder := _mounted(spark, path, pattern)) is not None:
        found = _read_mounted(spark, folder, pattern)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "false")
        if pattern:
            reader = reader.option("pathGlobFilter", pattern)
        found = reader.load(path)
    return found.select(F.col("path").alias("file"), T.base_name("path").alias("name"), "content")


def _mounted(spark: SparkSession, path: str, pattern: str | None) -> str | None:
    """The full path of a directory that is mounted; none for single files, globs and stores that only Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getUri().getScheme() != "file" or set(pattern or "") & set("{}\\^"):
        return None
    folder = files.makeQualified(at).toUri().getPath()
    return folder if os.path.isdir(folder) else None


def _names(folder: str, pattern: str | None) -> Iterator[str]:
    """Names of the files that Spark would list: none that is hidden or still copied."""
    with os.scandir(folder) as entries:
        for e in entries:
            hidden = e.name[0] == "." or e.name[0] == "_" and "=" not in e.name or e.name.endswith("._COPYING_")
            if not hidden and (pattern is None or fnmatchcase(e.name, pattern)) and e.is_file():
                yield e.name


def _read_mounted(spark: SparkSession, folder: str, pattern: str | None) -> DataFrame:
    """(path, content) of a directory's files.

    A task lists the directory and deals the names out, so neither they nor
    a task for every few files are held by the driver.
    """

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(b.num_rows for b in batches):
            for some in batched(_names(folder, pattern), LISTED):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["name"])

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, contents, size = [], [], 0
            for k, name in enumerate(b.column("name").to_pylist(), 1):
                with open(os.path.join(folder, name), "rb") as f:
                    names.append(f"file:{os.path.join(folder, name)}")
                    contents.append(f.read())
                size += len(contents[-1])
                if size >= READ_BYTES or k == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])
                    names, contents, size = [], [], 0

    tasks = max(TASKS_A_CORE * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = spark.range(0, 1, 1, 1).mapInArrow(listing, "name string")
    return names.repartition(tasks).mapInArrow(reading, "path string, content binary")


def strict_utf8(content: Column) -> Column:
    """Decoded text; malformed bytes raise.  A byte order mark stays."""
    return F.decode(content, "UTF-8")


def read_text(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, name, content STRING), strictly UTF-8, newlines as they are."""
    return read_bytes(spark, path, pattern).withColumn("content", strict_utf8(F.col("content")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) with terminators kept."""
    return explode_lines(read_text(spark, path))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON value a file, as text."""
    return read_text(spark, path)


def read_chat_files(spark: SparkSession, path: str) -> DataFrame:
    """Chat export pages (file, name, content, file_no); a page that isn't UTF-8 is left out, the others stay."""
    pages = read_bytes(spark, path, "messages*.html").withColumn("content", F.col("content").cast("string")).filter(F.is_valid_utf8("content"))
    return pages.withColumn("file_no", T.chat_file_number("name"))
