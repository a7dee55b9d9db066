"""Home, trips, everyday periods and the stops of trips."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import arrow_map
from ..config import DEFAULTS
from ..functions.calendar import micros, week_start
from ..functions.geo import EARTH_METERS, haversine
from ..scratch import stored
from .sequence import carried, joined, running_sum, with_totals


def home_country(photos: DataFrame) -> DataFrame:
    """project, home: the most frequent country, the first seen on ties; null where no row has one."""
    filled = F.when(F.col("country_code") != "", F.col("country_code"))
    per = photos.groupBy("project", filled.alias("cc")).agg(F.count("*").alias("n"), F.min(F.struct("ts", "id")).alias("at"))
    return per.groupBy("project").agg(F.min_by("cc", F.when(F.col("cc").isNotNull(), F.struct((-F.col("n")).alias("r"), "at"))).alias("home"))


def home_centroid(photos: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """project, home, home_lat, home_lon: mean of placed rows whose country is home or unknown; of all placed rows if there are none."""
    homes = home_country(photos) if homes is None else homes
    rows = photos.where(F.col("lat").isNotNull()).join(homes, "project")
    near = F.coalesce(F.col("country_code") == F.col("home"), F.lit(True)) | (F.col("country_code") == "")
    mean = lambda c: F.coalesce(F.avg(F.when(near, F.col(c))), F.avg(c))
    centre = rows.groupBy("project").agg(mean("lat").alias("home_lat"), mean("lon").alias("home_lon"))
    return homes.join(centre, "project", "left")


def away_rows(photos: DataFrame, config=DEFAULTS, two_level: bool = False) -> DataFrame:
    """``photos`` with away: another country than home, or too far from its centre; rows with neither inherit (at first: home)."""
    rows = joined(photos, home_centroid(photos), ["project"])
    country = F.when(F.col("country_code") != "", F.col("country_code"))
    far = haversine(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon")) > config.away_km * 1000
    abroad = F.coalesce(country != F.col("home"), F.lit(False))
    known = F.when(country.isNotNull() | F.col("lat").isNotNull(), abroad | F.coalesce(far, F.lit(False)))
    rows = carried(rows.withColumn("__known", known), {}, {"__past": F.col("__known")}, two_level)
    return rows.withColumn("away", F.coalesce("__known", "__past", F.lit(False))).drop("__known", "__past", "home", "home_lat", "home_lon")


def away_runs(photos: DataFrame, config=DEFAULTS, two_level: bool = False) -> DataFrame:
    """``photos`` with away, run_no and is_trip: runs of one state without a gap over the limit; long and rich away runs are trips.

    ``two_level``: the same for projects too large for one task.
    """
    rows = carried(away_rows(photos, config, two_level), {"__t": micros(F.col("ts")), "__away": F.col("away")}, {}, two_level)
    gap = micros(F.col("ts")) - F.col("__t") > config.trip_gap_days * 86_400e6
    rows = rows.withColumn("__break", F.coalesce(gap | (F.col("away") != F.col("__away")), F.lit(False)).cast("int"))
    rows = running_sum(rows, "__break", "run_no", two_level).drop("__break", "__t", "__away")
    of_run = {"__n": F.count("*"), "__first": F.min(micros(F.col("ts"))), "__last": F.max(micros(F.col("ts")))}
    rows = with_totals(rows, ["project", "run_no"], of_run, two_level)
    long = F.col("__last") - F.col("__first") >= config.trip_min_hours * 3600e6
    return rows.withColumn("is_trip", F.col("away") & (F.col("__n") >= config.trip_min_rows) & F.coalesce(long, F.lit(False))).drop(*of_run)


def period_rows(runs: DataFrame, config=DEFAULTS, two_level: bool = False) -> DataFrame:
    """Everyday rows with kind (``month`` or ``week``) and key; weeks lie inside their month, so their key names both."""
    rows = runs.where(~F.col("is_trip")).withColumn("__month", F.date_format("ts", "yyyy-MM"))
    rows = with_totals(rows, ["project", "__month"], {"__n": F.count("*")}, two_level)
    rows = rows.withColumn("kind", F.when(F.col("__n") >= config.weekly_min_rows, "week").otherwise("month")).drop("__n")
    key = F.when(F.col("kind") == "week", F.concat_ws(":", F.col("__month"), week_start(F.col("ts")).cast("string"))).otherwise(F.col("__month"))
    return rows.withColumn("key", key).drop("__month")


def _cards(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"),
        F.min_by("id", F.struct(F.col("lat").isNull().alias("x"), "ts", "id")).alias("cover_id"), F.array_sort(F.collect_set("country_code")).alias("countries"),
    )


def trips(runs: DataFrame) -> DataFrame:
    return _cards(runs.where("is_trip"), ["project", "run_no"])


def periods(runs: DataFrame, config=DEFAULTS, two_level: bool = False) -> DataFrame:
    return _cards(period_rows(runs, config, two_level), ["project", "kind", "key"])


def moments(photos: DataFrame, config=DEFAULTS, two_level: bool = False) -> DataFrame:
    """Trips and everyday periods of every project, latest first; ``two_level``: for projects too large for one task."""
    runs = stored(away_runs(photos, config, two_level).select("project", "id", "ts", "lat", "country_code", "run_no", "is_trip"))  # ordered once for both parts
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    t = trips(runs).select("project", F.concat_ws(":", F.lit("trip"), day("start"), day("end")).alias("moment_id"), F.lit("trip").alias("kind"), "start", "end", "n", "cover_id", "countries")
    p = periods(runs, config, two_level).select("project", F.concat_ws(":", F.lit("period"), "kind", "key").alias("moment_id"), "kind", "start", "end", "n", "cover_id", "countries")
    return t.unionByName(p).orderBy(F.col("start").desc(), "project", "moment_id")


_STOPS = pa.schema([
    ("project", pa.int64()), ("run_no", pa.int64()), ("stop_no", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()), ("gps", pa.int64()), ("n", pa.int64()),
    ("start", pa.timestamp("us")), ("end", pa.timestamp("us")), ("country", pa.string()), ("cover_id", pa.int64()),
])


def _meters(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    half_lat, half_lon = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * half_lon * half_lon
    return 2 * EARTH_METERS * math.asin(min(1.0, math.sqrt(a)))


def _fold_stops(meters: float):
    """Over rows sorted by trip and time: holds the open stop only, and hands on each stop as it closes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, stop, number = None, None, 0
        for batch in batches:
            done = []
            for project, run_no, ts, photo, lat, lon, country in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if trip != (project, run_no):
                    if stop:
                        done.append(stop)
                    trip, stop, number = (project, run_no), None, 0
                if lat is None:
                    if stop:
                        stop["n"] += 1
                    continue
                if stop and _meters(lat, lon, stop["lat"] / stop["gps"], stop["lon"] / stop["gps"]) <= meters:
                    stop |= {"lat": stop["lat"] + lat, "lon": stop["lon"] + lon, "gps": stop["gps"] + 1, "n": stop["n"] + 1, "end": ts, "country": country or stop["country"]}
                    continue
                if stop:
                    done.append(stop)
                stop = {"project": project, "run_no": run_no, "stop_no": number, "lat": lat, "lon": lon, "gps": 1, "n": 1, "start": ts, "end": ts, "country": country, "cover_id": photo}
                number += 1
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_STOPS)
        if stop:
            yield pa.RecordBatch.from_pylist([stop], schema=_STOPS)

    return run


def trip_stops(runs: DataFrame, radius_km: float = DEFAULTS.stop_km) -> DataFrame:
    """project, run_no, stop_no, lat, lon, gps, n, start, end, country, cover_id of each trip's stops.

    A placed row beyond the radius of the current stop's running mean opens the next stop, so what a row does depends on earlier decisions:
    a fold over each trip's rows as a sorted stream (memory: one stop). Rows without a place only count for an open stop.
    """
    key = ["project", "run_no"]
    rows = runs.where("is_trip").select(*key, "ts", "id", "lat", "lon", "country_code").repartition(*key).sortWithinPartitions(*key, "ts", "id")
    schema = "project bigint, run_no bigint, stop_no int, lat double, lon double, gps bigint, n bigint, start timestamp_ntz, end timestamp_ntz, country string, cover_id bigint"
    sums = arrow_map(rows, _fold_stops(radius_km * 1000), schema)
    return sums.withColumns({"lat": F.col("lat") / F.col("gps"), "lon": F.col("lon") / F.col("gps")})


def stop_assignment(runs: DataFrame, stops: DataFrame) -> DataFrame:
    """Every row of a trip with its stop: the first that ends at or after the row, else the last.

    An as-of join without a join per pair: rows and stop ends are laid in one order, and each row looks ahead for the next end.
    """
    rows = runs.where("is_trip").select("project", "run_no", "ts", "id", F.lit(None).cast("int").alias("stop_no"), F.lit(0).alias("kind"))
    ends = stops.select("project", "run_no", F.col("end").alias("ts"), F.lit(None).cast("long").alias("id"), "stop_no", F.lit(1).alias("kind"))
    key = ["project", "run_no"]
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in ("ts", "kind", "stop_no", "id")])  # backwards: the ends of a time stand before its rows
    ahead = F.last("stop_no", True).over(w.rowsBetween(Window.unboundedPreceding, 0))  # grows by a row at a time
    last = F.max("stop_no").over(Window.partitionBy(*key))
    both = rows.unionByName(ends).withColumn("__stop", F.coalesce(ahead, last)).where("kind = 0 and __stop is not null")
    return both.select(*key, "id", F.col("__stop").alias("stop_no"))
