"""What the operators share: tables, staged intermediates and Arrow batch helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

from loomtext.sources.tables import read_spread, read_table

#: Bytes of text that a Python worker holds decoded or hashed at a time (a single longer text is taken whole).
PIECE = 2 << 20
#: Tables of whole texts, which a single file would leave to one core.
SPREAD = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return (read_spread if name in SPREAD else read_table)(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session that names none gets a temporary one, any other is refused."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomtext-"))
    return sc.getCheckpointDir()


class Staging:
    """Intermediate tables in the shared folder: they cut lineage and survive lost executors.

    Tables that nothing reads any more are dropped at once; those that a
    returned DataFrame reads go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}", 0
        self.there: set[str] = set()

    def _at(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        if self.n == 1:
            root, files = self._at(self.root)
            files.deleteOnExit(root)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        self.there.add(path)
        return out

    def drop(self, *staged: DataFrame) -> None:
        for df in staged:
            self._delete(df._staged_at)

    def drop_others(self, *kept: DataFrame) -> None:
        for path in self.there - {df._staged_at for df in kept}:
            self._delete(path)

    def _delete(self, path: str) -> None:
        at, files = self._at(path)
        files.delete(at, True)
        self.there.discard(path)


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    col = batch.column(text)
    if not len(col):
        return
    size = np.zeros(len(col), np.int64)
    sizes = pa.compute.binary_length(col).fill_null(0)
    size[:] = np.asarray(sizes)
    group = np.cumsum(size + 1) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(col)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def map_pieces(fn: Callable[[pa.RecordBatch], pa.RecordBatch], text: str = "text", limit: int = PIECE):
    """A mapInArrow function that applies ``fn`` to bounded slices of each batch.

    Workers outlive tasks, so a task gives free memory back at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text, limit):
                yield fn(piece)
        pa.default_memory_pool().release_unused()

    return run


def map_texts(fn: Callable[[str], tuple], names: list[str], types: list[pa.DataType], keep: list[str], text: str = "text"):
    """A mapInArrow function: ``fn(text)`` for each row (null: empty), after the columns ``keep``."""

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        rows = [fn(t or "") for t in piece.column(text).to_pylist()]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays([piece.column(k) for k in keep] + cols, keep + names)

    return map_pieces(one, text)
