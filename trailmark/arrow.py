"""Arrow maps whose tasks find this package."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: This package's folder.
PACKAGE = Path(__file__).resolve().parent


def shipped(spark: SparkSession) -> None:
    """Puts this package at hand on the executors, wherever it is installed on the driver."""
    context = spark.sparkContext
    if not any(os.path.basename(f) == f"{PACKAGE.name}.zip" for f in context.listFiles):
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        context.addPyFile(path)


def released() -> None:
    """Gives the memory that a task has freed back to the system: idle workers stay for a minute beside the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors (``shipped``); a task's worker is ``released`` at its end."""
    shipped(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        released()

    return df.mapInArrow(run, schema)
