"""Scalar expressions against known values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trailmark.functions import calendar as cal
from trailmark.functions.geo import clamp_radius, haversine, in_ring
from trailmark.functions.keywords import folder_keywords
from trailmark.functions.labels import country_name, date_range_label, kind_flags
from trailmark.operators.sequence import resolve_scale


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def texts(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_distance(spark):
    paris, london = (F.lit(48.8566), F.lit(2.3522)), (F.lit(51.5074), F.lit(-0.1278))
    far, same = one(spark, haversine(*paris, *london), haversine(*paris, *paris))
    assert abs(far - 344_000) < 15_000 and same == 0


def test_clamp_radius():
    assert [clamp_radius(x) for x in (None, 0, float("nan"), 10, 1e9, 120)] == [300, 300, 300, 50, 50_000, 120]


def test_offsets(spark):
    assert texts(spark, ["+02:00", "-07:30", "+0200", "Z", "", "nope", None], cal.parse_offset) == [120, -450, 120, 0, None, None, None]
    minutes = [-720, -450, 0, 120, 330, 840]
    rows = spark.createDataFrame([(m,) for m in minutes], "m INT")
    assert [r[0] for r in rows.select(cal.parse_offset(cal.format_offset(F.col("m")))).collect()] == minutes


def test_wall_time(spark):
    got = texts(spark, ["2024:05:04 10:11:12", "2024-05-04T10:11:12Z", "0000:00:00 00:00:00", "2024:13:01 00:00:00", "x", None], cal.parse_wall_time)
    when = datetime(2024, 5, 4, 10, 11, 12)
    assert got[:2] == [when, when] and got[3:] == [None, None, None] and got[2] is None


@pytest.mark.parametrize(("offset", "lon", "minutes"), [("+02:00", 100.0, 120), ("junk", 100.0, 420), (None, -7.5, 0), (None, None, 30), ("junk", 7.5, 60)])
def test_normalize_utc(spark, offset, lon, minutes):
    wall = F.lit(datetime(2024, 1, 1, 12)).cast("timestamp_ntz")
    utc, used = cal.normalize_utc(wall, F.lit(offset).cast("string"), F.lit(lon).cast("double"), host_minutes=30)
    got = one(spark, utc.alias("u"), used.alias("m"))
    assert got[1] == minutes and (datetime(2024, 1, 1, 12) - got[0]).total_seconds() == minutes * 60


def test_period_keys(spark):
    rows = spark.createDataFrame([(datetime(2024, 5, 4, 10),), (datetime(2009, 12, 31, 23),), (None,)], "ts TIMESTAMP_NTZ")
    got = rows.select(*[c.alias(k) for k, c in cal.period_keys(F.col("ts")).items()]).collect()
    assert [tuple(r) for r in got] == [("2020s", "2024", "2024-05"), ("2000s", "2009", "2009-12"), (None, None, None)]


def test_number(spark):
    assert texts(spark, ["1.5", "-2e3x", ".5", "x", "", None, "12abc"], cal.number) == [1.5, -2000.0, 0.5, None, None, None, 12.0]


def test_keywords(spark):
    got = texts(spark, ["Tokyo_Japan-Trip.2025", "DCIM 100CANON", "The Old Tokyo tokyo", "Été à Paris", "", None, "P1000 gopr Rome"], folder_keywords)
    assert got == [["tokyo", "japan", "trip"], [], ["tokyo"], ["paris"], [], [], ["rome"]]
    assert texts(spark, ["Summer Rome"], lambda c: folder_keywords(c, ("Summer",))) == [["rome"]]


@pytest.mark.parametrize(
    ("start", "end", "label"),
    [
        ("2024-05-05", "2024-05-05", "May 5, 2024"), ("2024-05-04", "2024-05-07", "May 4–7, 2024"), ("2024-01-02", "2024-12-20", "2024"), ("2024-06-01", "2024-08-30", "Summer 2024"),
        ("2024-03-01", "2024-09-30", "Mar – Sep 2024"), ("2019-01-01", "2024-06-01", "2019–2024"), ("2023-12-01", "2024-01-05", "Dec 2023 – Jan 2024"), ("2024-02-01", "2024-12-20", "Winter 2024"),
    ],
)
def test_date_labels(spark, start, end, label):
    a, b = (F.lit(datetime.fromisoformat(x)).cast("timestamp_ntz") for x in (start, end))
    assert one(spark, date_range_label(a, b)) == (label,)


def test_date_label_without_dates(spark):
    none = F.lit(None).cast("timestamp_ntz")
    assert one(spark, date_range_label(none, none), date_range_label(F.lit(datetime(2024, 5, 5)).cast("timestamp_ntz"), none)) == ("", "May 5, 2024")


def test_country_and_kind(spark):
    assert one(spark, country_name(F.lit("US")), country_name(F.lit("FR"), F.lit("France")), country_name(F.lit("XX"))) == ("United States", "France", "XX")
    flags = lambda p: one(spark, *kind_flags(F.lit(p)).values())
    assert flags("a/B.JPG") == ("jpg", True, True) and flags("x.png") == ("png", True, False) and flags("x.heic") == ("heic", False, False) and flags("x") == (None, False, False)


def test_ring(spark):
    ring = F.lit([[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0]])
    inside = lambda x, y: in_ring(F.lit(x), F.lit(y), ring)
    assert one(spark, inside(1.0, 1.0), inside(2.0, 2.0), inside(5.0, 1.0), inside(3.5, 3.0)) == (True, False, False, True)


def test_scales():
    ends = resolve_scale(0), resolve_scale(24)
    assert (ends[0].tier, ends[0].seconds, ends[1].tier) == ("Event", pytest.approx(7200), "Year")
    assert resolve_scale(8).tier == "Trip" and resolve_scale(-5).step == 0 and resolve_scale(99).step == 24 and resolve_scale("x").step == 8
    seconds = [resolve_scale(i).seconds for i in range(25)]
    assert seconds == sorted(seconds) and len(set(seconds)) == 25
