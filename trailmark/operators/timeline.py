"""Pages, totals, facets, calendar, day groups and fingerprints of a catalog."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .filters import base, between, month_range


def parse_cursor(cursor: str) -> tuple[datetime, int]:
    """``<timestamp>|<id>``, parted at the last bar."""
    when, _, last = cursor.rpartition("|")
    return datetime.fromisoformat(when), int(last)


def timeline_page(photos: DataFrame, limit: int | None = None, cursor: str | None = None, config=DEFAULTS) -> DataFrame:
    """Newest rows first (then largest id), after the cursor; a keyset page, planned as a distributed top-k."""
    n = min(config.page_max, max(1, limit or config.page_size))
    rows = base(photos)
    if cursor:
        when, last = parse_cursor(cursor)
        at = F.lit(when).cast("timestamp_ntz")
        rows = rows.where((F.col("ts") < at) | ((F.col("ts") == at) & (F.col("id") < last)))
    return rows.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def next_cursor(page: DataFrame, limit: int | None = None, config=DEFAULTS) -> str | None:
    """The cursor after a page (at most ``page_max`` rows); none if the page isn't full."""
    n = min(config.page_max, max(1, limit or config.page_size))
    last = page.agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("k")).first()
    return f"{last.k.ts.isoformat(sep=' ')}|{last.k.id}" if last.n == n else None


def catalog_totals(photos: DataFrame) -> DataFrame:
    """One pass per project: rows, rows with a place, date range of the base rows, and missing rows."""
    usable = (F.col("status") == "active") & F.col("ts").isNotNull()
    when = lambda c: F.when(usable, c)
    return photos.groupBy("project").agg(
        F.count(when(F.lit(1))).alias("n"), F.count(when(F.col("lat"))).alias("n_geo"), F.min(when(F.col("ts"))).alias("first_ts"),
        F.max(when(F.col("ts"))).alias("last_ts"), F.count(F.when(F.col("status") == "missing", 1)).alias("n_missing"),
    )


def facets(photos: DataFrame, by: str) -> DataFrame:
    """Active rows by ``country_code``, ``camera_model`` or ``year``; dates may be missing, values may not. Largest first, then by value; years latest first."""
    value = F.date_format("ts", "yyyy") if by == "year" else F.col(by)
    counted = photos.where(F.col("status") == "active").groupBy(value.alias("value")).agg(F.count("*").alias("n")).where("value is not null")
    return counted.orderBy(F.col("value").desc()) if by == "year" else counted.orderBy(F.col("n").desc(), "value")


def calendar(photos: DataFrame, year: str | None = None, month: str | None = None) -> DataFrame:
    """Years (latest first); with a year its months, with year and month (``01``) its days, earliest first. A month without a year gives years."""
    form = "yyyy" if not year else "yyyy-MM" if not month else "yyyy-MM-dd"
    rows = base(photos)
    if year:  # a half-open range on ts, which reaches the scan
        rows = between(rows, *month_range(f"{year}-{month}")) if month else between(rows, datetime(int(year), 1, 1), datetime(int(year) + 1, 1, 1))
    counted = rows.groupBy(F.date_format("ts", form).alias("key")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.col("key") if year else F.col("key").desc())


def calendar_levels(photos: DataFrame) -> DataFrame:
    """All levels at once: (level, key, n). Rows are counted by day; months and years add up the days."""
    days = base(photos).groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("c"))
    keys = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}
    each = days.select("c", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.date_format("d", f).alias("key")) for k, f in keys.items()])).alias("p"))
    return each.groupBy("p.level", "p.key").agg(F.sum("c").alias("n"))


def day_groups(photos: DataFrame) -> DataFrame:
    """Rows and distinct countries by project and UTC day."""
    return base(photos).groupBy("project", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("country_code")).alias("countries"))


def geo_listing(photos: DataFrame) -> DataFrame:
    """Placed rows by date."""
    placed = base(photos).where(F.col("lat").isNotNull())
    return placed.select("id", "file_name", "folder_name", "ts", "lat", "lon", "country_code").orderBy("ts", "id")


def fingerprint(photos: DataFrame, photo_tags: DataFrame | None = None, photo_clusters: DataFrame | None = None) -> DataFrame:
    """What changes whenever a catalog does: rows, largest id, latest change; with the link tables also their numbers of links."""
    changed = F.max("mtime") if "mtime" in photos.columns else F.max(F.unix_micros(F.col("ts").cast("timestamp")))
    out = photos.groupBy("project").agg(F.count("*").alias("n"), F.max("id").alias("max_id"), changed.alias("max_change"))
    for name, links in (("n_tag_links", photo_tags), ("n_cluster_links", photo_clusters)):
        if links is not None:
            out = out.join(links.groupBy("project").agg(F.count("*").alias(name)), "project", "left").fillna(0, [name])
    return out
