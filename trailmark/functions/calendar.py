"""Period keys, UTC offsets and normalisation of wall-clock time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less UTC timestamp (the session's zone is UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def period_keys(ts: Column) -> dict[str, Column]:
    """decade (``2020s``), year and month of a timestamp; null for null."""
    year = F.year(ts)
    return {
        "decade": F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s")),
        "year": F.lpad(year.cast("string"), 4, "0"),
        "month": F.date_format(ts, "yyyy-MM"),
    }


def week_start(ts: Column) -> Column:
    """Monday of the timestamp's week."""
    return F.to_date(F.date_trunc("week", ts))


def parse_offset(text: Column) -> Column:
    """Minutes of ``±HH:MM``, ``±HHMM`` or ``Z``; null for anything else."""
    t = F.trim(text)
    part = lambda i: F.regexp_extract(t, r"^([+-])(\d{2}):?(\d{2})$", i)
    minutes = part(2).try_cast("int") * 60 + part(3).try_cast("int")
    return F.when(t == "Z", F.lit(0)).when(part(1) == "-", -minutes).when(part(1) == "+", minutes)


def format_offset(minutes: Column) -> Column:
    size = F.abs(minutes)
    return F.when(minutes.isNotNull(), F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(size / 60), size % 60))


def parse_wall_time(text: Column) -> Column:
    """Timestamp of a ``YYYY:MM:DD HH:MM:SS`` prefix (``-`` and ``T`` also part it); null if a part is out of range."""
    part = lambda i: F.regexp_extract(text, r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2}):(\d{2})", i)
    known = F.when(part(1) != "", F.format_string("%s-%s-%s %s:%s:%s", *[part(i) for i in range(1, 7)]))
    return known.try_cast("timestamp_ntz")


def normalize_utc(wall: Column, offset: Column, lon: Column, host_minutes: int = 0) -> tuple[Column, Column]:
    """(UTC timestamp, minutes of offset used): the text's own offset, else the longitude's whole hours, else the host's."""
    minutes = F.coalesce(parse_offset(offset), (F.floor(lon / 15 + 0.5) * 60).cast("int"), F.lit(host_minutes))
    return wall - F.make_interval(mins=minutes), minutes


def number(text: Column) -> Column:
    """Leading number of a text; null if there is none or it isn't finite."""
    n = F.regexp_extract(F.trim(text.cast("string")), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)
