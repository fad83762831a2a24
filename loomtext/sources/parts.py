"""A sink that writes parts under exact names.

Rows (name, line_no, line) are dealt by name and sorted, so each file is
streamed by one task, whatever its size.  A task writes in a folder of its own,
hidden in the target folder, and lists its names there.  When all tasks have
ended, other tasks rename the files of each list; if one fails before that, no
file is in place.  The hidden folder goes in both cases.  The driver hears of
one folder a task, however many files there are.  Files of a name are
overwritten, others stay.  The folder must be one that all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Byte order mark that chat parts begin with.
BOM = "﻿"
#: Fixed value: what a task calls the list of its files' names; the files themselves have numbers.
NAMES = "names"

Batches = Iterator[pa.RecordBatch]


def _task(own: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([own], pa.string())], ["task"])


def _checked(name: str | None) -> str:
    if not name or "/" in name or name in (".", ".."):
        raise ValueError(f"{name!r} is no file name")
    return name


def _writing(staging: str, mark: str) -> Callable[[Batches], Batches]:
    """Writes sorted rows as numbered files and tells where."""

    def run(batches: Batches) -> Batches:
        own = os.path.join(staging, uuid.uuid4().hex)
        os.mkdir(own)
        name, n, f = None, 0, None
        try:
            with open(os.path.join(own, NAMES), "w", encoding="utf-8") as names:
                for b in batches:
                    for key, value in zip(b.column("name"), b.column("line")):
                        key, line = key.as_py(), value.as_py()
                        if f is None or key != name:
                            if f is not None:
                                f.close()
                            name = _checked(key)
                            f = open(os.path.join(own, str(n)), "w", encoding="utf-8", newline="")
                            names.write(json.dumps(name) + "\n")
                            n += 1
                            if line:
                                f.write(mark)
                        f.write(line or "")
        finally:
            if f is not None:
                f.close()
        yield _task(own)

    return run


def _placing(folder: str) -> Callable[[Batches], Batches]:
    """Renames the files of each task; those that an earlier attempt has renamed are in place already."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            for own in b.column("task").to_pylist():
                with open(os.path.join(own, NAMES), encoding="utf-8") as names:
                    for k, name in enumerate(map(json.loads, names)):
                        try:
                            os.replace(os.path.join(own, str(k)), os.path.join(folder, name))
                        except FileNotFoundError:
                            if not os.path.exists(os.path.join(folder, name)):
                                raise
                yield _task(own)

    return run


def write_parts(rows: DataFrame, folder: str, mark: str = "") -> None:
    """Writes (name, line_no, line); a name with one null line becomes an empty file; ``mark`` starts each non-empty one."""
    folder = os.path.abspath(folder)
    staging = os.path.join(folder, f".loomparts-{uuid.uuid4().hex}")
    os.makedirs(staging)
    dealt = rows.select("name", F.col("line_no").cast("long").alias("line_no"), "line").repartition("name").sortWithinPartitions("name", "line_no")
    try:
        tasks = dealt.select("name", "line").mapInArrow(_writing(staging, mark), "task string").collect()
        rows.sparkSession.createDataFrame(tasks, "task string").mapInArrow(_placing(folder), "task string").collect()
    finally:
        shutil.rmtree(staging, ignore_errors=True)
