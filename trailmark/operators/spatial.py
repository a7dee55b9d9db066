"""Joins by distance in space and time, and points in polygons."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import micros
from ..functions.geo import EARTH_METERS, haversine, in_ring, in_sides, ring_sides
from ..scratch import stored

DEGREE_METERS = math.pi * EARTH_METERS / 180


def band_cells(meters: float) -> tuple[float, callable, callable]:
    """Height of a latitude band, its number and the number of longitude cells around it.

    A band is a little higher than the radius; its cells are as wide as the radius reaches anywhere in the band or next to it, so
    partners lie within one band and, in that band's own cells, within one cell.
    """
    height = meters / DEGREE_METERS * 1.001
    band = lambda lat: F.floor(lat / height).cast("long")

    def around(b: Column) -> Column:
        edge = F.least(F.greatest(F.abs((b - 1) * height), F.abs((b + 2) * height)), F.lit(90.0))
        reach = 2 * F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(meters / (2 * EARTH_METERS), math.pi / 2))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))))
        return F.greatest(F.floor(360 / (F.degrees(reach) * 1.001)), F.lit(1)).cast("long")

    return height, band, around


def cell_number(lon: Column, n: Column) -> Column:
    return F.least(F.floor((lon + 180) / 360 * n), n - 1).cast("long")


def radius_join(left: DataFrame, right: DataFrame, meters: float, *, wrap: bool = False) -> DataFrame:
    """l_id, r_id, meters for all pairs of one project within ``meters``, inclusive. Inputs: project, id, lat, lon.

    An equi-join on (project, band, cell): the left side is exploded into its nine neighbouring cells, the right side isn't; hot cells
    are split by adaptive execution. ``wrap`` also joins across the 180th meridian.
    """
    _, band, around = band_cells(meters)
    l = left.where(F.col("lat").isNotNull()).select("project", F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))  # noqa: E741
    l = l.withColumn("band", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: band(F.col("l_lat")) + d))).withColumn("n", around(F.col("band")))  # noqa: E741
    near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: cell_number(F.col("l_lon"), F.col("n")) + d)
    near = F.transform(near, lambda c: F.pmod(c, F.col("n"))) if wrap else near
    l = l.withColumn("cell", F.explode(F.array_distinct(near))).drop("n")  # noqa: E741
    r = right.where(F.col("lat").isNotNull()).select("project", F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    r = r.withColumn("band", band(F.col("r_lat"))).withColumn("cell", cell_number(F.col("r_lon"), around(F.col("band"))))
    gap = haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))
    pairs = l.join(r, ["project", "band", "cell"]).withColumn("meters", gap).where(F.col("meters") <= meters)
    return pairs.select("project", "l_id", "r_id", "meters")


def time_join(left: DataFrame, right: DataFrame, seconds: float) -> DataFrame:
    """l_id, r_id of all pairs of one project at most ``seconds`` apart, inclusive. Inputs: project, id, ts.

    Buckets as wide as the window: the left side takes its own and both neighbours, then an equi-join and the exact test.
    """
    width = int(seconds * 1e6)
    l = left.where(F.col("ts").isNotNull()).select("project", F.col("id").alias("l_id"), micros(F.col("ts")).alias("l_t"))  # noqa: E741
    l = l.withColumn("bucket", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.floor(F.col("l_t") / width) + d)))  # noqa: E741
    r = right.where(F.col("ts").isNotNull()).select("project", F.col("id").alias("r_id"), micros(F.col("ts")).alias("r_t")).withColumn("bucket", F.floor(F.col("r_t") / width))
    return l.join(r, ["project", "bucket"]).where(F.abs(F.col("l_t") - F.col("r_t")) <= width).select("project", "l_id", "r_id")


#: Lengths of the window that a stretch of ``count_within`` holds.
STRETCH = 8


def in_stretches(events: DataFrame, width: int) -> DataFrame:
    """The dated rows with __t (microseconds), __own and __stretch: a row is listed with its own stretch, and with the next one if it is less than ``width`` from it."""
    rows = events.where(F.col("ts").isNotNull()).withColumn("__t", micros(F.col("ts")))
    number = lambda shift: F.floor((F.col("__t") + shift) / (STRETCH * width))
    return rows.withColumn("__own", number(0)).withColumn("__stretch", F.explode(F.array_distinct(F.array(*[number(d) for d in (-width, 0, width)]))))


def count_within(events: DataFrame, keys: list[str], seconds: float, weight: str) -> DataFrame:
    """``events`` (with ``keys``, ts) and n_within: the sum of ``weight`` over the rows of the same keys at most ``seconds`` away, the row itself among them.

    Range windows over stretches of ``STRETCH`` times the window: only rows near a stretch's end are listed twice (``in_stretches``), no window
    holds more than a stretch and its rims of one key, and no pair is made, however dense a burst is.
    """
    width = int(seconds * 1e6)
    near = Window.partitionBy(*keys, "__stretch").orderBy("__t").rangeBetween(-width, width)
    return in_stretches(events, width).withColumn("n_within", F.sum(weight).over(near)).where("__own = __stretch").drop("__t", "__own", "__stretch")


def neighbour_pairs(photos: DataFrame, meters: float) -> DataFrame:
    """project, a, b (a < b), meters of placed rows within ``meters``."""
    _, band, around = band_cells(meters)
    at = F.struct("id", "lat", "lon")
    rows = photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("project", at.alias("r"), band(F.col("lat")).alias("band"))
    rows = rows.withColumn("cell", cell_number(F.col("r.lon"), around(F.col("band"))))
    # each pair is met once: a row looks into its own cell, the next one and the three above
    above = cell_number(F.col("r.lon"), around(F.col("band") + 1))
    key = lambda up, cell: F.struct((F.col("band") + up).alias("band"), cell.alias("cell"), F.lit(False).alias("own"))
    own = F.struct("band", "cell", F.lit(True).alias("own"))
    keys = F.array(own, key(0, F.col("cell") + 1), *[key(1, above + d) for d in (-1, 0, 1)])
    l = rows.select("project", F.col("r").alias("l"), F.explode(keys).alias("k")).select("project", "l", "k.*")  # noqa: E741
    met = l.join(rows, ["project", "band", "cell"]).where((F.col("l.id") < F.col("r.id")) | (~F.col("own") & (F.col("l.id") > F.col("r.id"))))
    a, b = (F.when(F.col("l.id") < F.col("r.id"), F.col(x)).otherwise(F.col(y)) for x, y in (("l", "r"), ("r", "l")))
    pairs = met.select("project", a.alias("a"), b.alias("b")).withColumn("meters", haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")))
    return pairs.where(F.col("meters") <= meters).select("project", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "meters")


#: Side of the largest tiles in degrees, how often they are halved, and the segments that a tile may hold without being halved.
TILE, HALVINGS, SEGMENTS = 8.0, 6, 16
#: Tiles up to this many rows are sent to all executors; more are joined by shuffle.
BROADCAST_TILES = 200_000


def boundary_tiles(boundaries: DataFrame, tile: float = TILE, halvings: int = HALVINGS, segments: int = SEGMENTS) -> DataFrame:
    """level, tx, ty and found (array of ordinal, iso, ring_no, by ordinal): the tiles of a quadtree and the rings that may hold their points.

    A tile that rings' segments touch is halved on both axes while it holds more than ``segments`` of them. In a tile that none of a ring's segments
    touches, one point decides for all: the ring is listed without a number if it holds the tile, and not at all if it doesn't. Rings listed with a number are
    to be tested. What follows a ring that holds the whole tile can't be the first, and is left out. ``boundaries``: ring_no, ordinal, iso, ring.
    """
    end = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))), F.slice("ring", 1, 1))
    sides = boundaries.where(F.size("ring") > 0).select("ring_no", F.explode(F.arrays_zip(F.col("ring").alias("p"), end.alias("q"))).alias("s")).select("ring_no", *[F.col(f"s.{a}")[i].alias(f"{a}{n}") for a in "pq" for i, n in enumerate("xy")])
    number = lambda c, level: F.floor(c / F.lit(tile) * F.pow(F.lit(2.0), level)).cast("long")
    axis = lambda i: F.transform("ring", lambda v: v[i])
    box = boundaries.select("ring_no", *[f(axis(i)).alias(n) for i, f, n in ((0, F.array_min, "x1"), (0, F.array_max, "x2"), (1, F.array_min, "y1"), (1, F.array_max, "y2"))])
    zero = F.lit(0)
    over = lambda a, b: F.explode(F.sequence(number(a, zero), number(b, zero)))
    open_ = box.where("x1 is not null").select("ring_no", over(F.col("x1"), F.col("x2")).alias("tx"), F.col("y1"), F.col("y2")).withColumn("ty", over(F.col("y1"), F.col("y2"))).select("ring_no", "tx", "ty")
    held, leaves = sides.select("*", over(F.least("px", "qx"), F.greatest("px", "qx")).alias("tx")).withColumn("ty", over(F.least("py", "qy"), F.greatest("py", "qy"))), []
    for level in range(halvings + 1):
        size = tile / 2**level
        x1, y1 = F.col("tx") * size, F.col("ty") * size
        slack = size * 1e-6
        # a segment misses a tile if all corners lie on one side of its line, or its box misses the tile
        turn = lambda x, y: (F.col("qx") - F.col("px")) * (y - F.col("py")) - (F.col("qy") - F.col("py")) * (x - F.col("px"))
        corners = F.array(*[turn(x1 + a, y1 + b) for a in (-slack, size + slack) for b in (-slack, size + slack)])
        beside = (F.array_min(corners) > 0) | (F.array_max(corners) < 0)
        misses = (F.greatest("px", "qx") < x1 - slack) | (F.least("px", "qx") > x1 + size + slack) | (F.greatest("py", "qy") < y1 - slack) | (F.least("py", "qy") > y1 + size + slack)
        held = stored(held.where(~beside & ~misses))
        touched = held.groupBy("ring_no", "tx", "ty").agg(F.count("*").alias("n"))
        crowd = touched.groupBy("tx", "ty").agg(F.sum("n").alias("n")).where(F.col("n") > (segments if level < halvings else F.lit(1 << 62))).select("tx", "ty")
        state = stored(open_.join(touched, ["ring_no", "tx", "ty"], "left").join(crowd.withColumn("large", F.lit(True)), ["tx", "ty"], "left"))
        leaves.append(state.where("large is null").select(F.lit(level).alias("level"), "tx", "ty", "ring_no", F.col("n").isNotNull().alias("edge")))
        if level == halvings or state.where("large").isEmpty():
            break
        halves = lambda df: df.withColumn("tx", F.explode(F.array(F.col("tx") * 2, F.col("tx") * 2 + 1))).withColumn("ty", F.explode(F.array(F.col("ty") * 2, F.col("ty") * 2 + 1)))
        open_ = halves(state.where("large").select("ring_no", "tx", "ty"))
        held = halves(held.join(crowd, ["tx", "ty"], "left_semi").select("ring_no", "px", "py", "qx", "qy", "tx", "ty"))
    listed = reduce(DataFrame.unionByName, leaves).join(boundaries.select("ring_no", "ordinal", "iso", "ring"), "ring_no")
    middle = lambda c: (F.col(c) + 0.5) * tile / F.pow(F.lit(2.0), F.col("level"))
    kept = listed.withColumn("holds", F.when(~F.col("edge"), in_ring(middle("tx"), middle("ty"), F.col("ring")))).where("edge or holds")
    rows = kept.groupBy("level", "tx", "ty").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.when(F.col("edge"), F.col("ring_no")).alias("ring_no"), "iso"))).alias("found"))
    first = F.array_min(F.transform(F.filter("found", lambda x: x["ring_no"].isNull()), lambda x: x["ordinal"]))
    return rows.withColumn("found", F.filter("found", lambda x: F.coalesce((x["ordinal"] < first) | ((x["ordinal"] == first) & x["ring_no"].isNull()), F.lit(True))))


#: Rings of its tile that a point is tested against in the first round, and how many times as many in each further one.
FIRST_RINGS, MORE = 4, 4


def geocode(points: DataFrame, boundaries: DataFrame, tile: float = TILE, halvings: int = HALVINGS) -> DataFrame:
    """project, id, iso: the first country (by ordinal) one of whose rings holds the point; no row otherwise.

    ``boundaries``: ordinal, iso, ring (array of [lon, lat]), one row a ring. A point looks up its tile (``boundary_tiles``); in most tiles the answer stands
    there, and only points of tiles that a ring's sides cross are tested against these rings: against the first few by ordinal, then, in rounds, those
    that none of them holds against the next ones. Where many rings overlap, few points meet them all.
    """
    rings = stored(boundaries.select("ordinal", "iso", "ring").withColumn("ring_no", F.monotonically_increasing_id()))
    tiles = stored(boundary_tiles(rings, tile, halvings))
    sides = stored(rings.select("ring_no", ring_sides(F.col("ring")).alias("sides")))
    where = ["level", "tx", "ty"]
    heads = tiles.select(*where, F.col("found")[0].alias("head"), F.size("found").alias("rings"))
    heads = F.broadcast(heads) if tiles.count() <= BROADCAST_TILES else heads
    number = lambda c, level: F.floor(F.col(c) / F.lit(tile) * F.pow(F.lit(2.0), level)).cast("long")
    placed = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("project", "id", "lat", "lon")
    keys = F.transform(F.sequence(F.lit(0), F.lit(halvings)), lambda k: F.struct(k.alias("level"), number("lon", k).alias("tx"), number("lat", k).alias("ty")))
    met = placed.withColumn("k", F.explode(keys)).select("project", "id", "lat", "lon", "k.*").join(heads, where)
    point = ["project", "id", "lat", "lon", *where, "rings"]
    plain = met.where(F.col("head.ring_no").isNull()).select("project", "id", F.col("head.iso").alias("iso"))
    state = stored(met.where(F.col("head.ring_no").isNotNull()).select(*point))
    done, step, out = 0, FIRST_RINGS, [plain]
    while not state.isEmpty():
        some = tiles.select(*where, F.explode(F.slice("found", done + 1, step)).alias("c")).select(*where, "c.*")
        tested = state.join(some, where).join(sides, "ring_no", "left")
        holds = F.col("ring_no").isNull() | in_sides(F.col("lon"), F.col("lat"), F.col("sides"))
        first = stored(tested.groupBy(*point).agg(F.min(F.when(holds, F.struct("ordinal", "iso"))).alias("first")))
        out.append(first.where("first is not null").select("project", "id", F.col("first.iso").alias("iso")))
        done, step = done + step, step * MORE
        state = first.where(F.col("first").isNull() & (F.col("rings") > done)).select(*point)
    return reduce(DataFrame.unionByName, out)
