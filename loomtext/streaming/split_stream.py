"""Splitting the files that arrive in a directory.

Each file is complete when it arrives, so the batch operators apply to a
micro-batch of files; the checkpoint remembers which files are done, and the
sink overwrites by name, so a batch that runs again gives the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.functions import text as T
from loomtext.operators.lines import explode_lines
from loomtext.operators.split import METHODS
from loomtext.sources.files import strict_utf8
from loomtext.sources.parts import write_parts

_FILE = "path string, modificationTime timestamp, length long, content binary"


def split_arrivals(spark: SparkSession, path: str, folder: str, method: str, value, checkpoint: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Starts a query that splits all files present in ``path``, new ones since its last run only, and stops."""

    def batch(arrived: DataFrame, _: int) -> None:
        lines = explode_lines(arrived.select(F.col("path").alias("file"), strict_utf8(F.col("content")).alias("content")))
        parts = METHODS[method](lines, value)
        write_parts(parts.select(T.part_name(T.base_name("file"), "part_no").alias("name"), "line_no", "line"), folder)

    arrivals = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_batch).load(path)
    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
