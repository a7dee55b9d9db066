"""Distances and polygons as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS

EARTH_METERS = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere between two points in degrees; null if any coordinate is."""
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_METERS) * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # least() would pass over a null


def clamp_radius(meters: float | None, config=DEFAULTS) -> float:
    """A radius within the allowed range; the default for nothing, zero or NaN."""
    if not meters or math.isnan(meters):
        return config.radius_default
    return min(config.radius_max, max(config.radius_min, float(meters)))


def ring_sides(ring: Column) -> Column:
    """The sides of a ring (array of [lon, lat]) that a ray along a parallel may cross: each vertex (x1, y1) with its predecessor (x2, y2)."""
    closing = F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.size(ring) - 1))
    sides = F.zip_with(ring, closing, lambda v, u: F.struct(v[0].alias("x1"), v[1].alias("y1"), u[0].alias("x2"), u[1].alias("y2")))
    return F.filter(sides, lambda s: s["y1"] != s["y2"])


def in_sides(lon: Column, lat: Column, sides: Column) -> Column:
    """``in_ring`` for a ring's sides, found once (``ring_sides``)."""
    spans = F.filter(sides, lambda s: (s["y1"] > lat) != (s["y2"] > lat))
    left_of = lambda s: lon < (s["x2"] - s["x1"]) * (lat - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]
    return F.size(F.filter(spans, left_of)) % 2 == 1


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray from the point crosses the ring (array of [lon, lat]) an odd number of times."""
    closing = F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.size(ring) - 1))  # each vertex's predecessor

    def crosses(v: Column, u: Column) -> Column:
        above = (v[1] > lat) != (u[1] > lat)
        return above & (lon < (u[0] - v[0]) * (lat - v[1]) / F.when(above, u[1] - v[1]) + v[0])

    return F.aggregate(F.zip_with(ring, closing, crosses), F.lit(False), lambda odd, hit: odd != F.coalesce(hit, F.lit(False)))
