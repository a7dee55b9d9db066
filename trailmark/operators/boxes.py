"""Neighbours within a radius without pairs of rows: trees of boxes that are judged against each other.

A cell is so small that any two of its rows are neighbours. Crowded cells are halved on both axes, again and again, until a box holds a few rows. Two
boxes whose farthest corners are within the radius are neighbours as a whole; two whose nearest sides are beyond it have no pair; others are taken apart, and
only the rows of small boxes at the rim are compared one by one. Sums, counts and minima over neighbours come from the boxes' own. Every
round is a join of boxes written to the shared folder; there are as many rounds as levels at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_METERS, haversine
from ..scratch import dropped, stored
from .graph import components
from .spatial import DEGREE_METERS, band_cells, cell_number, neighbour_pairs, radius_join

#: Rows that a box may hold without being halved, and how often a cell is halved at most.
LEAF, DEPTH = 32, 10
#: Relative slack of a box's bounds for rounding.
SLACK = 1e-9
ROOT = ["project", "band", "cell"]
#: Side of the tiles in which roots meet, in radii of their join.
TILES = 4


def cells(meters: float) -> tuple[Column, Column, Column, Column]:
    """Band and cell of a row (lat, lon), and its place inside the cell on both axes, from 0 to 1. Any two rows of a cell are within ``meters``."""
    side = meters / math.sqrt(2) * 0.999
    height = side / DEGREE_METERS
    band = F.floor(F.col("lat") / height).cast("long")
    inner = F.least(F.abs(band * height), F.abs((band + 1) * height))
    inner = F.when(band.isin(0, -1), 0.0).otherwise(inner)  # the band's widest latitude
    around = F.greatest(F.ceil(F.cos(F.radians(F.least(inner, F.lit(90.0)))) * 360 * DEGREE_METERS / side), F.lit(1)).cast("long")
    cell = cell_number(F.col("lon"), around)
    return band, cell, F.col("lat") / height - band, (F.col("lon") + 180) / 360 * around - cell


def crowd(photos: DataFrame, meters: float) -> int:
    """The largest number of placed rows in a cell."""
    band, cell, *_ = cells(meters)
    placed = photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return placed.groupBy("project", band.alias("band"), cell.alias("cell")).count().agg(F.max("count")).first()[0] or 0


@dataclass
class Boxes:
    """rows: project, id, lat, lon, root's keys, y, x (place at the deepest level), level (of the row's leaf), few (whether the root has no more rows than a leaf may have),
    and further columns asked for.

    boxes: box (struct of the root's keys, level, y, x), parent (null for a root), n, y1, y2, x1, x2, leaf. tables: what was written for both.
    """

    rows: DataFrame
    boxes: DataFrame
    tables: tuple[DataFrame, ...] = ()

    def sides(self) -> DataFrame:
        """box, and all that is needed to judge it, as one struct ``b``."""
        return self.boxes.select("box", "parent", F.struct("box", "y1", "y2", "x1", "x2", "leaf").alias("b"))

    def paths(self, used: DataFrame) -> DataFrame:
        """id, box of every row and each of its boxes that is among ``used`` (box)."""
        return self.rows.select("id", F.explode(F.transform(F.sequence(F.lit(0), F.col("level")), _box)).alias("box")).join(used, "box", "left_semi")

    def paths_with(self, used: DataFrame, *columns: str) -> DataFrame:
        """box and ``columns`` of every row and its root, and each of its further boxes that is among ``used`` (box). A root is a neighbour of itself as a whole, so none is looked up."""
        below = self.rows.where("level > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.col("level")), _box)).alias("box"), *columns)
        return self.rows.select(_box(F.lit(0)).alias("box"), *columns).unionByName(below.join(used.where("box.level > 0").distinct(), "box", "left_semi"))


def _box(level: Column) -> Column:
    shrink = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.lit(DEPTH) - level)).cast("int")
    return F.struct(*[F.col(k) for k in ROOT], level.cast("int").alias("level"), shrink("y").alias("y"), shrink("x").alias("x"))


def boxed(photos: DataFrame, meters: float, leaf: int = LEAF, also: tuple[str, ...] = ()) -> Boxes:
    """The trees of all placed rows (project, id, lat, lon), which keep the columns ``also``.

    Only rows of roots to be halved are counted in finer boxes; where there is none, as in thin places, rows are written once and shuffled once.
    """
    band, cell, y, x = cells(meters)
    deep = lambda c: F.least(F.greatest(F.floor(c * 2**DEPTH), F.lit(0)), F.lit(2**DEPTH - 1)).cast("int")
    placed = photos.where(F.col("project").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    rows = stored(placed.select("project", "id", "lat", "lon", band.alias("band"), cell.alias("cell"), deep(y).alias("y"), deep(x).alias("x"), *also))
    box = [f(c).alias(n) for n, f, c in (("y1", F.min, "lat"), ("y2", F.max, "lat"), ("x1", F.min, "lon"), ("x2", F.max, "lon"))]
    over = [F.sum("n").alias("n"), *[f(c).alias(c) for f, c in ((F.min, "y1"), (F.max, "y2"), (F.min, "x1"), (F.max, "x2"))]]
    one = (F.col("y1") == F.col("y2")) & (F.col("x1") == F.col("x2"))
    done = (F.col("n") <= leaf) | one | (F.col("box.level") == DEPTH)
    zero, sides = F.lit(0), ["n", "y1", "y2", "x1", "x2"]
    root = F.struct(*ROOT, zero.alias("level"), zero.alias("y"), zero.alias("x")).alias("box")
    roots = stored(rows.groupBy(*ROOT).agg(F.count("*").alias("n"), *box).select(root, *sides).withColumn("leaf", done))
    up = F.struct(*[F.col(f"box.{k}").alias(k) for k in ROOT], (F.col("box.level") - 1).alias("level"), *[F.floor(F.col(f"box.{k}") / 2).cast("int").alias(k) for k in ("y", "x")])
    tree = lambda d: d.withColumn("parent", F.when(F.col("box.level") > 0, up))
    large = stored(roots.where(F.col("n") > leaf).select(*[F.col(f"box.{k}").alias(k) for k in ROOT], "leaf"))  # where they are few, they are sent to the rows
    if large.isEmpty():
        dropped(large)
        return Boxes(rows.withColumns({"level": zero, "few": F.lit(True)}), tree(roots), (rows, roots))
    crowded = large.where("not leaf").drop("leaf")
    levels = F.explode(F.transform(F.sequence(F.lit(1), F.lit(DEPTH)), _box)).alias("box")
    deepest = rows.join(crowded, ROOT).groupBy(*ROOT, "y", "x").agg(F.count("*").alias("n"), *box)
    lower = stored(deepest.select(levels, *sides).groupBy("box").agg(*over).withColumn("leaf", done))
    open_ = roots.where("not leaf").select("box").unionByName(lower.where("not leaf").select("box")).withColumnRenamed("box", "parent")
    halves = stored(tree(lower).join(open_, "parent", "left_semi"))
    leaves = halves.where("leaf").select(F.col("box").alias("own"), F.col("box.level").alias("level"))
    flat = rows.join(large, ROOT, "left_anti").withColumns({"level": zero, "few": F.lit(True)})
    same = rows.join(large.where("leaf").drop("leaf"), ROOT).withColumns({"level": zero, "few": F.lit(False)})
    split = rows.join(crowded, ROOT).withColumn("own", levels).join(leaves, "own").withColumn("few", F.lit(False))
    leveled = stored(flat.unionByName(same.select(*flat.columns)).unionByName(split.select(*flat.columns)))
    dropped(rows, large, lower)
    every = tree(roots)
    return Boxes(leveled, every.unionByName(halves.select(*every.columns)), (leveled, roots, halves))


def root_pairs(left: Boxes, right: Boxes, meters: float) -> DataFrame:
    """l, r: the roots of one project that may have neighbours in each other: those with middles within twice ``meters``, as ``radius_join`` finds them.

    Roots meet in tiles of ``TILES`` times that radius: a left root is listed in its own tile, and in others only if they are in reach, not in nine cells.
    A project has one root a cell, so a tile holds a bounded number of them.
    """
    reach = 2 * meters
    _, band, around = band_cells(reach)
    _, tile_band, tile_around = band_cells(TILES * reach)
    sides = ["y1", "y2", "x1", "x2", "leaf"]

    def roots(t: Boxes, s: str) -> DataFrame:
        flat = t.boxes.where("parent is null and box.project is not null").select(*[F.col(f"box.{k}").alias(k) for k in ROOT], *sides)
        at = {"lat": (F.col("y1") + F.col("y2")) / 2, "lon": (F.col("x1") + F.col("x2")) / 2}
        return flat.withColumns(at).select("project", *[F.col(c).alias(f"{s}_{c}") for c in (*ROOT[1:], *sides, "lat", "lon")])

    lat, lon = F.col("l_lat"), F.col("l_lon")
    up = reach / DEGREE_METERS * 1.001
    edge = F.least(F.abs(lat) + up, F.lit(90.0))
    aside = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(reach / (2 * EARTH_METERS), math.pi / 2))) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))))) * 1.001
    number = lambda x: F.floor((x + 180) / 360 * F.col("__n")).cast("long")
    l = roots(left, "l").withColumn("__band", F.explode(F.sequence(tile_band(lat - up), tile_band(lat + up)))).withColumn("__n", tile_around(F.col("__band")))  # noqa: E741
    first = number(lon - aside)
    listed = F.sequence(first, F.least(number(lon + aside), first + F.col("__n") - 1))
    l = l.withColumn("__cell", F.explode(F.transform(listed, lambda c: F.pmod(c, F.col("__n"))))).drop("__n")  # noqa: E741
    r = roots(right, "r").withColumn("__band", tile_band(F.col("r_lat"))).withColumn("__cell", cell_number(F.col("r_lon"), tile_around(F.col("__band"))))
    l, r = (d.drop(f"{s}_lat", f"{s}_lon") for d, s in ((l, "l"), (r, "r")))  # found again after the shuffle
    met = l.join(r, ["project", "__band", "__cell"])
    met = met.withColumns({f"{s}_{c}": (F.col(f"{s}_{k}1") + F.col(f"{s}_{k}2")) / 2 for s in "lr" for c, k in (("lat", "y"), ("lon", "x"))})
    row, n = band(F.col("r_lat")), around(band(F.col("r_lat")))
    beside = (F.abs(band(F.col("l_lat")) - row) <= 1) & (F.abs(cell_number(F.col("l_lon"), n) - cell_number(F.col("r_lon"), n)) <= 1)
    met = met.where(F.abs(F.col("l_lat") - F.col("r_lat")) <= up).where(haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= reach).where(beside)
    zero = F.lit(0)
    box = lambda s: F.struct("project", *[F.col(f"{s}_{k}").alias(k) for k in ROOT[1:]], zero.alias("level"), zero.alias("y"), zero.alias("x"))
    return met.select(*[F.struct(box(s).alias("box"), *[F.col(f"{s}_{c}").alias(c) for c in sides]).alias(s) for s in "lr"])


def _meters(half_lat: Column, cosines: Column, half_lon: Column) -> Column:
    s = F.sin(half_lat) * F.sin(half_lat) + cosines * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2 * EARTH_METERS) * F.asin(F.sqrt(F.least(s, F.lit(1.0))))


def bounds(l: str = "l", r: str = "r") -> tuple[Column, Column]:  # noqa: E741
    """Metres that any two points of two boxes are apart at least and at most."""
    at = lambda s, c: F.col(f"{s}.{c}")
    least = lambda a, b: F.greatest(F.lit(0.0), at(l, a) - at(r, b), at(r, a) - at(l, b))
    most = lambda a, b: F.greatest(at(l, b) - at(r, a), at(r, b) - at(l, a))
    far = lambda s: F.greatest(F.abs(at(s, "y1")), F.abs(at(s, "y2")))
    near = lambda s: F.when((at(s, "y1") <= 0) & (at(s, "y2") >= 0), 0.0).otherwise(F.least(F.abs(at(s, "y1")), F.abs(at(s, "y2"))))
    cosines = lambda f: F.cos(F.radians(f(l))) * F.cos(F.radians(f(r)))
    half = lambda c: F.radians(c) / 2
    wide = most("x1", "x2") > 180  # around a pole: no bound by longitude
    low = _meters(half(least("y1", "y2")), cosines(far), F.when(wide, 0.0).otherwise(half(least("x1", "x2"))))
    high = _meters(half(most("y1", "y2")), cosines(near), F.when(wide, math.pi / 2).otherwise(half(most("x1", "x2"))))
    return low, high


def judged(pairs: DataFrame, meters: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of pairs of boxes (l, r and further columns): those that are neighbours as a whole, small ones at the rim, and those to be taken apart."""
    low, high = bounds()
    known = pairs.withColumn("__high", high).where(low <= meters * (1 + SLACK))
    whole, small = F.col("__high") <= meters * (1 - SLACK), F.col("l.leaf") & F.col("r.leaf")
    return known.where(whole).drop("__high"), known.where(~whole & small).drop("__high"), known.where(~whole & ~small).drop("__high")


def taken_apart(pairs: DataFrame, left: Boxes, right: Boxes) -> DataFrame:
    """``pairs`` with the halves of their large boxes."""
    for side, tree in (("l", left), ("r", right)):
        halves = tree.sides().where("parent is not null").groupBy(F.col("parent").alias(f"__{side}")).agg(F.collect_list("b").alias("__halves"))  # four at most
        met = pairs.withColumn(f"__{side}", F.col(f"{side}.box")).join(halves, f"__{side}", "left")
        pairs = met.withColumn(side, F.explode(F.coalesce("__halves", F.array(side)))).drop("__halves", f"__{side}")
    return pairs


def compared(rims: DataFrame, left: Boxes, right: Boxes, meters: float) -> DataFrame:
    """l_id, r_id and the further columns of ``rims``: the neighbours among the rows of small boxes."""
    of = lambda t, s: t.rows.select(_box(F.col("level")).alias(f"__{s}"), F.col("id").alias(f"{s}_id"), F.col("lat").alias(f"{s}_lat"), F.col("lon").alias(f"{s}_lon"))
    more = [c for c in rims.columns if c not in ("l", "r")]
    pairs = rims.select(F.col("l.box").alias("__l"), F.col("r.box").alias("__r"), *more).join(of(left, "l"), "__l").join(of(right, "r"), "__r")
    return pairs.where(haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= meters).select("l_id", "r_id", *more)


@dataclass
class Near:
    """All neighbours of the left rows among the right ones: whole boxes (l, r) and pairs of rows (l_id, r_id)."""

    left: Boxes
    right: Boxes
    whole: DataFrame
    pairs: DataFrame
    tables: tuple[DataFrame, ...] = ()

    def combined(self, values: DataFrame, combine: Callable[[str], Column], keys: tuple[str, ...] = ()) -> DataFrame:
        """id, keys, value: ``combine`` over the values (id, keys, value) of each left row's neighbours, itself included if it is among them."""
        by_box = self.right.paths(self.whole.select(F.col("r").alias("box")).distinct()).join(values, "id").groupBy("box", *keys).agg(combine("value").alias("value"))
        seen = self.whole.join(by_box, F.col("r") == F.col("box")).groupBy(F.col("l").alias("box"), *keys).agg(combine("value").alias("value"))
        of_rows = self.left.paths(seen.select("box").distinct()).join(seen, "box").select("id", *keys, "value")
        one = self.pairs.join(values.withColumnRenamed("id", "r_id"), "r_id").groupBy(F.col("l_id").alias("id"), *keys).agg(combine("value").alias("value"))
        return of_rows.unionByName(one.select(*of_rows.columns)).groupBy("id", *keys).agg(combine("value").alias("value"))

    def tagged(self, values: DataFrame) -> DataFrame:
        """id, name, value: how many neighbours of each left row carry a tag that the row doesn't; without a name, how many neighbours it has, itself included.

        Both sides' rows have names (array, of their tags) and copies (how often each counts as a neighbour); ``values``: id, names, copies, one row an id. Rows of large
        roots are summed by tag and box first, others stay as they are: no box brings more than a leaf's rows or its own tags to a pair, and none is shuffled tag by tag.
        """
        every = lambda names: F.explode(F.concat(names, F.array(F.lit(None).cast("string")))).alias("name")
        value = F.when(F.col("name").isNull(), F.col("copies")).otherwise(F.col("n")).alias("value")
        one = F.lit(1).cast("long").alias("n")
        rows = self.right.paths_with(self.whole.select(F.col("r").alias("box")), "names", "copies", "few")
        summed = rows.where("not few").select("box", "copies", one, every(F.col("names"))).groupBy("box", "name").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies"))
        summed = summed.select("box", F.array_compact(F.array("name")).alias("names"), F.when(F.col("name").isNull(), F.col("copies")).otherwise(0).alias("copies"), "n")
        parts = rows.where("few").select("box", "names", "copies", one).unionByName(summed)
        met = self.whole.join(parts, F.col("r") == F.col("box")).select(F.col("l").alias("box"), "names", "copies", "n").repartition("box")
        seen = met.select("box", "n", "copies", every(F.col("names"))).select("box", "name", value).groupBy("box", "name").agg(F.sum("value").alias("value"))
        own = self.left.paths_with(self.whole.select(F.col("l").alias("box")), "id", "names")
        of_rows = own.join(seen, "box").where(F.col("name").isNull() | ~F.array_contains("names", F.col("name"))).select("id", "name", "value")
        pairs = self.pairs.join(values.select(F.col("id").alias("l_id"), F.col("names").alias("own")), "l_id").join(values.withColumnRenamed("id", "r_id"), "r_id")
        of_pairs = pairs.select(F.col("l_id").alias("id"), one, "copies", every(F.array_except("names", "own"))).select("id", "name", value)
        return of_rows.unionByName(of_pairs).groupBy("id", "name").agg(F.sum("value").alias("value"))


def near(left: Boxes, right: Boxes, meters: float) -> Near:
    """Judges the pairs of boxes, level by level; of pairs that needn't be taken apart only the boxes' names are written, once."""
    pairs, states = root_pairs(left, right, meters), []
    low, high = bounds()
    kind = F.when(high <= meters * (1 - SLACK), 0).when(F.col("l.leaf") & F.col("r.leaf"), 1).otherwise(2)  # as ``judged``
    large = lambda c: F.when(F.col("kind") == 2, F.col(c)).alias(c)
    while True:
        judged_ = pairs.where(low <= meters * (1 + SLACK)).withColumn("kind", kind)
        states.append(stored(judged_.select("kind", F.col("l.box").alias("l_box"), F.col("r.box").alias("r_box"), large("l"), large("r"))))
        rest = states[-1].where("kind = 2").select("l", "r")
        if rest.isEmpty():
            break
        pairs = taken_apart(rest, left, right)
    of = lambda k: reduce(DataFrame.unionByName, [s.where(F.col("kind") == k).select("l_box", "r_box") for s in states])
    rims = stored(of(1).select(F.struct(F.col("l_box").alias("box")).alias("l"), F.struct(F.col("r_box").alias("box")).alias("r")))  # few: no row is shuffled for them
    pairs = stored(compared(rims, left, right, meters))
    dropped(rims)
    return Near(left, right, of(0).select(F.col("l_box").alias("l"), F.col("r_box").alias("r")), pairs, (*states, pairs))


def linked(pairs: DataFrame, tree: Boxes, meters: float) -> DataFrame:
    """a, b of the pairs of cells (a, b, l, r) that have two rows within ``meters``: a pair leaves as soon as two of its boxes or rows are."""
    state, found = stored(pairs), None
    while not state.isEmpty():
        whole, rim, large = judged(state, meters)
        hit = stored(whole.select("a", "b").unionByName(compared(rim, tree, tree, meters).select("a", "b")).distinct())
        found = hit if found is None else found.unionByName(hit)
        last, state = state, stored(taken_apart(large.join(hit, ["a", "b"], "left_anti"), tree, tree))
        dropped(last)
    return state.select("a", "b") if found is None else found


def linked_cells(photos: DataFrame, meters: float, sparse: int = 64) -> DataFrame:
    """a, b: edges whose components are those of all pairs within ``meters``, without making the pairs of a dense place.

    Cells are so small that any two of their rows are neighbours, so a cell is a star around its smallest id. Cells are linked by one pair: first
    between their outermost rows in eight directions. Where two cells in reach still belong to different components, boxes of their rows are judged
    against each other (``linked``). Where no cell holds more than ``sparse`` rows a row has few partners, and the pairs themselves are the edges.
    """
    band, cell, y, x = cells(meters)
    rows = stored(photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("project", "id", "lat", "lon", band.alias("band"), cell.alias("cell"), y.alias("y"), x.alias("x")))
    keys = ROOT
    if (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= sparse:
        return neighbour_pairs(rows, meters).select("a", "b")
    outer = [f(F.struct(e.alias("e"), "id", "lat", "lon")).alias(f"o{i}{n}") for i, e in enumerate((F.col("y"), F.col("x"), F.col("y") + F.col("x"), F.col("y") - F.col("x"))) for n, f in enumerate((F.min, F.max))]
    crowds = stored(rows.groupBy(*keys).agg(F.min("id").alias("rep"), *outer))
    star = rows.join(crowds.select(*keys, "rep"), keys).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    at = F.array(*[F.struct(F.col(f"o{i}{n}.id").alias("id"), F.col(f"o{i}{n}.lat").alias("lat"), F.col(f"o{i}{n}.lon").alias("lon")) for i in range(4) for n in range(2)])
    rims = crowds.select("project", F.explode(F.array_distinct(at)).alias("o")).select("project", F.col("o.id").alias("id"), F.col("o.lat").alias("lat"), F.col("o.lon").alias("lon"))
    edges = stored(star.unionByName(radius_join(rims, rims, meters).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))))
    roots = components(edges)
    rooted = crowds.select(*keys, "rep").join(roots, F.col("rep") == F.col("node"), "left").select(*keys, "rep", F.coalesce("root", "rep").alias("root"))
    tree = boxed(rows, meters)
    of = lambda s: stored(rooted).select(F.struct(*keys, *[F.lit(0).alias(c) for c in ("level", "y", "x")]).alias("box"), F.col("rep").alias(s), F.col("root").alias(f"{s}_root"))
    met = root_pairs(tree, tree, meters).join(of("a"), F.col("l.box") == F.col("box")).drop("box").join(of("b"), F.col("r.box") == F.col("box")).drop("box")
    return edges.unionByName(linked(met.where("a < b and a_root <> b_root").select("a", "b", "l", "r"), tree, meters))
