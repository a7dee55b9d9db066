"""The predicates that all views share, as plain Column filters and semi-joins."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def base(photos: DataFrame) -> DataFrame:
    """Active rows that have a date."""
    return photos.where((F.col("status") == "active") & F.col("ts").isNotNull())


def between(df: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Half-open range on ts: reaches the scan as a pushed filter."""
    return df.where((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def month_range(month: str) -> tuple[datetime, datetime]:
    start = datetime.strptime(month, "%Y-%m")
    return start, (start + timedelta(days=32)).replace(day=1)


def with_tags(photos: DataFrame, photo_tags: DataFrame, names: list[str], every: bool) -> DataFrame:
    """Rows that carry one of the tags, or every one of them: one semi-join, whatever the number of tags."""
    wanted = list(dict.fromkeys(n.strip().lower() for n in names if n.strip()))
    if not wanted:
        return photos
    hits = photo_tags.where(F.col("name").isin(*wanted)).select("project", "id", "name").distinct()
    if every and len(wanted) > 1:
        hits = hits.groupBy("project", "id").count().where(F.col("count") == len(wanted))
    return photos.join(hits.select("project", "id"), ["project", "id"], "left_semi")


def apply_filters(
    photos: DataFrame, *, photo_tags: DataFrame | None = None, photo_clusters: DataFrame | None = None, country: str | None = None, year: int | str | None = None,
    month: str | None = None, day: str | None = None, camera: str | None = None, cluster: int | None = None, tag: str | None = None, tags_all: str | None = None,
    search: str | None = None,
) -> DataFrame:
    """Base rows under all given predicates; an empty or zero value turns its predicate off.

    ``photo_tags``: project, id, name; ``photo_clusters``: project, id, cluster_id. In ``search`` % and _ are wildcards.
    """
    out = base(photos)
    if country:
        out = out.where(F.col("country_code") == country)
    if year:
        out = between(out, datetime(int(year), 1, 1), datetime(int(year) + 1, 1, 1))
    if month:
        out = between(out, *month_range(month))
    if day:
        start = datetime.strptime(day, "%Y-%m-%d")
        out = between(out, start, start + timedelta(days=1))
    if camera:
        out = out.where(F.col("camera_model") == camera)
    if search:
        term = f"%{search.lower()}%"
        out = out.where(F.lower("file_name").like(term) | F.lower("folder_name").like(term))
    if cluster:
        out = out.join(photo_clusters.where(F.col("cluster_id") == cluster), ["project", "id"], "left_semi")
    if tag:
        out = with_tags(out, photo_tags, [tag], every=False)
    if tags_all:
        out = with_tags(out, photo_tags, tags_all.split(","), every=True)
    return out
