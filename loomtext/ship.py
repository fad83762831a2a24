"""Makes the package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def _workers_see_it(spark: SparkSession) -> bool:
    """Workers search PYTHONPATH, and in local mode the current folder."""
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if spark.sparkContext.master.startswith("local["):
        known.add(Path.cwd())
    return HERE.parent in known


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once, unless workers find it anyway."""
    sc = spark.sparkContext
    if _workers_see_it(spark) or getattr(sc, "_loomtext_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="loomtext-")) / "loomtext.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(HERE.rglob("*.py")):
            z.write(p, p.relative_to(HERE.parent))
    sc.addPyFile(str(target))
    sc._loomtext_shipped = True
