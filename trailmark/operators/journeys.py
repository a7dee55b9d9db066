"""Tracks of placed rows, their statistics, and their projection to a pane."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.calendar import micros
from ..functions.geo import haversine
from .sequence import carried, in_order, running_sum


def assign_tracks(photos: DataFrame, max_km: float = DEFAULTS.journey_km, max_hours: float | None = DEFAULTS.journey_hours, two_level: bool = False) -> DataFrame:
    """Placed rows with track_no, leg_m (from the previous row of the track) and track_size. ``max_hours=None``: only distance breaks a track.

    ``two_level``: the same for projects too large for one task.
    """
    placed = photos.where(F.col("lat").isNotNull())
    rows = carried(placed, {"__lat": F.col("lat"), "__lon": F.col("lon"), "__t": micros(F.col("ts"))}, {}, two_level)
    rows = rows.withColumns({"leg_m": haversine(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")), "__gap": micros(F.col("ts")) - F.col("__t")})
    far = F.col("leg_m") > max_km * 1000
    if max_hours is not None:
        far = far | (F.col("__gap") > max_hours * 3.6e9)
    rows = rows.withColumn("__break", F.coalesce(far, F.lit(False)).cast("int"))
    rows = running_sum(rows, "__break", "track_no", two_level).withColumn("leg_m", F.when(F.col("__break") == 0, F.col("leg_m")))
    return rows.withColumn("track_size", F.count("*").over(Window.partitionBy("project", "track_no"))).drop("__gap", "__break", "__lat", "__lon", "__t")


def tracks(assigned: DataFrame) -> DataFrame:
    """Tracks of two and more rows."""
    return assigned.where("track_size >= 2").groupBy("project", "track_no").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.coalesce(F.sum("leg_m"), F.lit(0.0)).alias("path_m"))


def singles(assigned: DataFrame) -> DataFrame:
    return assigned.where("track_size = 1")


def journey_stats(assigned: DataFrame) -> DataFrame:
    """project, photos, tracks, standalone, total_m (over tracks only)."""
    per = assigned.groupBy("project", "track_no").agg(F.count("*").alias("n"), F.sum("leg_m").alias("m"))
    multi = F.col("n") >= 2
    return per.groupBy("project").agg(
        F.sum("n").alias("photos"), F.sum(multi.cast("long")).alias("tracks"), F.sum((~multi).cast("long")).alias("standalone"), F.coalesce(F.sum(F.when(multi, F.col("m"))), F.lit(0.0)).alias("total_m")
    )


def set_bbox(rows: DataFrame, keys: list[str], widen: float = 0.05) -> DataFrame:
    """keys and the box of the placed rows; an axis narrower than 1e-4 degrees is widened on both sides."""
    box = rows.where(F.col("lat").isNotNull()).groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))])
    for c in ("lat", "lon"):
        thin = F.col(f"max_{c}") - F.col(f"min_{c}") < 1e-4
        box = box.withColumn(f"__thin_{c}", thin).withColumns({f"min_{c}": F.when(F.col(f"__thin_{c}"), F.col(f"min_{c}") - widen).otherwise(F.col(f"min_{c}")), f"max_{c}": F.when(F.col(f"__thin_{c}"), F.col(f"max_{c}") + widen).otherwise(F.col(f"max_{c}"))}).drop(f"__thin_{c}")
    return box


def track_projection(photos: DataFrame, width: float = 960, height: float = 540, pad: float = 40, first: int = 80) -> DataFrame:
    """x, y of each project's first ``first`` placed rows in a pane: one scale for both axes, centred, north up."""
    placed = photos.where(F.col("lat").isNotNull()).withColumn("rank", F.row_number().over(in_order())).where(F.col("rank") <= first)
    rows = placed.join(set_bbox(placed, ["project"]), "project")
    span_lon, span_lat = F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat")
    scale = F.least((width - 2 * pad) / span_lon, (height - 2 * pad) / span_lat)
    x = (width - span_lon * scale) / 2 + (F.col("lon") - F.col("min_lon")) * scale
    y = height - ((height - span_lat * scale) / 2 + (F.col("lat") - F.col("min_lat")) * scale)
    return rows.select("project", "id", "rank", x.alias("x"), y.alias("y"))
