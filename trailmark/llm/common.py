"""Shared helpers: table access, shared scratch folders, Arrow maps and word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from ..scratch import checkpoint_dir, stored

__all__ = ["WORD", "arrow_map", "checkpoint_dir", "per_row", "stored", "table", "words_of"]

#: A word, as the contracts define it: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_row(
    df: DataFrame, column: str, fn: Callable[..., tuple], fields: list[tuple[str, pa.DataType, str]], keep: list[str],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """Maps every value of ``column`` through ``fn`` in Arrow batches; columns of ``keep`` pass through unchanged.

    ``fields``: (name, Arrow type, Spark type) of the tuple that ``fn(value)`` returns; with ``setup``, ``fn(state, value)``
    gets what ``setup()`` built once in the task.
    """
    names = [n for n, *_ in fields]
    types = [t for _, t, _ in fields]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema]
    schema = ", ".join([*kept, *(f"`{n}` {t}" for n, _, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            values = batch.column(len(keep))
            for at in range(0, batch.num_rows, 1024):
                part = [fn(*state, v.as_py()) for v in values.slice(at, 1024)]
                arrays = [pa.array([r[i] for r in part], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, 1024).columns[: len(keep)], *arrays], [*keep, *names])

    return arrow_map(df.select(*keep, F.col(column).alias("__value")), run, schema)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text as UTF-8, with A-Z lowered if ``lower``; ``bytes.split`` parts at exactly the white space that ``WORD`` excludes."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()
