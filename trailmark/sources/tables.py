"""Reading and writing the catalog's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table by its fixed schema: no inference, and missing columns read as null."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str) -> None:
    """The table in files that hold ranges of projects, so their number goes with the size and not with the number of projects.

    A filter on ``project`` skips the other files by their statistics. A large project takes several files, by ``id``.
    """
    keys = [c for c in ("project", "id") if c in df.columns]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{root}/{name}")


def write_version(df: DataFrame, root: str, partition: str) -> str:
    """A new version of a derived table (rollups by ``period_type``, clusters by ``radius_meters``) in a directory of its own.

    The reader switches when the caller publishes the path, so no reader sees half a table and a table may be built from itself.
    """
    path = f"{root}/version-{uuid.uuid4().hex}"
    df.write.partitionBy(partition).parquet(path)
    return path


def directories(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "directories").orderBy("project", "id")
