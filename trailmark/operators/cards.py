"""Cards of groups: span, size, countries, cover, previews, centre, box, path, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import folder_keywords
from ..functions.labels import country_name, date_range_label
from ..scratch import stored
from .sequence import path_km, spread_sample


def ordered_distinct(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, values: distinct values in order of first appearance."""
    first = rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(*keys, column).agg(F.min(F.struct("ts", "id")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", F.col(column).alias("v"))))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias("values"))


def dominant(counted: DataFrame, keys: list[str], value: str, n: str, at: str) -> DataFrame:
    """keys, value: the most frequent value, the earliest seen on ties."""
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col(n)).alias("r"), F.col(at).alias("at"))).alias(value))


def place_names(rows: DataFrame, keys: list[str], names: DataFrame | None = None) -> DataFrame:
    """keys, place: the strongest folder keyword and the dominant country; else the country; else ``Area``.

    ``names``: (iso, name) of the boundary data. Keywords that equal the country's code or name don't count.
    """
    seen = rows.where(F.col("country_code").isNotNull() & (F.col("country_code") != ""))
    counted = seen.groupBy(*keys, "country_code").agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("at"))
    country = dominant(counted, keys, "country_code", "n", "at")
    if names is not None:
        country = country.join(names.select(F.col("iso").alias("country_code"), "name"), "country_code", "left")
    country = country.select(*keys, "country_code", country_name(F.col("country_code"), F.col("name") if names is not None else None).alias("country"))
    groups = rows.select(*keys).distinct().join(country, keys, "left")
    words = rows.select(*keys, "ts", "id", F.posexplode(folder_keywords(F.col("folder_name"))).alias("pos", "word"))
    words = words.groupBy(*keys, "word").agg(F.count("*").alias("n"), F.min(F.struct("ts", "id", "pos")).alias("at")).join(country, keys, "left")
    same = (F.col("word") == F.lower("country_code")) | (F.col("word") == F.lower("country"))
    best = dominant(words.where(~F.coalesce(same, F.lit(False))), keys, "word", "n", "at")
    title = F.initcap("word")
    label = F.coalesce(F.when(F.col("country").isNull(), title).otherwise(F.concat(title, F.lit(", "), F.col("country"))), F.col("country"), F.lit("Area"))
    return groups.join(best, keys, "left").select(*keys, label.alias("place"))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def group_cards(grouped: DataFrame, mode: str, names: DataFrame | None = None, previews: int = 5, two_level: bool = False) -> DataFrame:
    """One row a (project, group_no) of ``assign_groups``; every part is a combinable aggregate on the same keys.

    Paths and previews need a group's order: with ``two_level`` in windows over days and over ranges of rows, so that a group may hold all rows.
    """
    keys = ["project", "group_no"]
    at = F.struct("ts", "id")
    grouped = stored(grouped)  # the parts need different columns: each would order the whole catalog again
    cards = grouped.groupBy(*keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.count("lat").alias("n_geo"),
        F.min_by("id", F.struct(F.col("lat").isNull().alias("x"), "ts", "id")).alias("cover_id"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
        F.min("lat").alias("min_lat"), F.min("lon").alias("min_lon"), F.max("lat").alias("max_lat"), F.max("lon").alias("max_lon"),
    )
    chosen = F.array_sort(F.collect_list(F.struct(at.alias("at"), "id")))
    shown = spread_sample(grouped, keys, previews, two_level).groupBy(*keys).agg(F.transform(chosen, lambda x: x["id"]).alias("preview_ids"))
    out = (
        cards.join(path_km(grouped, keys, two_level), keys, "left").join(ordered_distinct(grouped, keys, "country_code").withColumnRenamed("values", "countries"), keys, "left")
        .join(shown, keys, "left").join(place_names(grouped, keys, names), keys, "left")
    )
    out = out.withColumns({"km": round_half_up(F.coalesce("path_m", F.lit(0.0)) / 1000), "date_label": date_range_label(F.col("start"), F.col("end")), "is_geo": F.col("n_geo") > 0})
    title = F.when(F.col("is_geo"), F.col("place")).otherwise(F.col("date_label")) if mode == "spacetime" else F.col("date_label")
    name = F.concat_ws(":", F.lit(mode), F.col("group_no").cast("string"), F.date_format("start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return out.withColumns({"title": title, "group_id": name, "countries": F.coalesce("countries", F.array().cast("array<string>"))}).drop("path_m")


def group_members(grouped: DataFrame, project: int, group_no: int) -> DataFrame:
    return grouped.where((F.col("project") == project) & (F.col("group_no") == group_no)).orderBy("ts", "id")
