"""Decade, year and month rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import period_keys
from .filters import base


PERIODS = ("decade", "year", "month")
STATE = ["project", "type", "key", "country_code", "camera_model"]


def rollup_state(photos: DataFrame, periods: tuple[str, ...] = PERIODS, weight: Column | None = None) -> DataFrame:
    """project, type, key, country_code, camera_model, n: counts of the base rows from which rollups are made, and which can be added up.

    ``weight``: what a row counts (1), such as -1 for a row that is taken away.
    """
    keys = period_keys(F.col("ts"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("type"), keys[p].alias("key")) for p in periods]))
    rows = base(photos.withColumn("__w", F.lit(1).cast("long") if weight is None else weight.cast("long")))
    return rows.select("project", each.alias("p"), "country_code", "camera_model", "__w").groupBy("project", "p.type", "p.key", "country_code", "camera_model").agg(F.sum("__w").alias("n"))


def changed_state(state: DataFrame, added: DataFrame, removed: DataFrame, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """``state`` after a batch of changes: ``removed`` holds deleted rows and updated ones as they were, ``added`` new rows and updated ones as they are.

    Costs the batch and the state, which has a row a period, country and camera; the catalog isn't read.
    """
    parts = [state, rollup_state(added, periods), rollup_state(removed, periods, F.lit(-1))]
    return reduce(DataFrame.unionByName, parts).groupBy(*STATE).agg(F.sum("n").alias("n")).where("n <> 0")


def rollups_of(state: DataFrame) -> DataFrame:
    """project, period_type, period_key, photo_count, countries (sorted), cameras (structs, most frequent first, then by name)."""
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    by_camera = state.groupBy("project", "type", "key", filled("camera_model").alias("camera")).agg(F.sum("n").alias("n"), F.collect_set(filled("country_code")).alias("cc"))
    ranked = F.array_sort(F.collect_list(F.when(F.col("camera").isNotNull(), F.struct((-F.col("n")).alias("rank"), "camera"))))
    out = by_camera.groupBy("project", F.col("type").alias("period_type"), F.col("key").alias("period_key")).agg(
        F.sum("n").alias("photo_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cc")))).alias("countries"), ranked.alias("r")
    )
    return out.withColumn("cameras", F.transform("r", lambda x: F.struct(x["camera"].alias("camera"), (-x["rank"]).alias("n")))).drop("r")


def rollups(photos: DataFrame, periods: tuple[str, ...] = PERIODS) -> DataFrame:
    """The rollups of a catalog (see ``rollups_of``).

    Two levels of sums, combined before the shuffle: no list of rows is built, only the distinct countries and cameras of a period.
    """
    return rollups_of(rollup_state(photos, periods))


def rollup_json(rolled: DataFrame) -> DataFrame:
    """Countries as a JSON array and cameras as a JSON object in their order."""
    pair = lambda x: F.concat(F.to_json(F.array(x["camera"])).substr(F.lit(2), F.length(F.to_json(F.array(x["camera"]))) - 2), F.lit(":"), x["n"].cast("string"))
    return rolled.select(
        "project", "period_type", "period_key", "photo_count", F.to_json("countries").alias("countries_list"),
        F.concat(F.lit("{"), F.array_join(F.transform("cameras", pair), ","), F.lit("}")).alias("camera_models_counts"),
    )


def read_rollups(rolled: DataFrame, period_type: str) -> DataFrame:
    """One type, latest first."""
    if period_type not in ("decade", "year", "month"):
        raise ValueError(f"no such period: {period_type}")
    return rolled.where(F.col("period_type") == period_type).orderBy(F.col("period_key").desc(), "project")
