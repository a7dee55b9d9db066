"""Counts and minima over the neighbours within a radius, where these are so many that neither they nor boxes at the rim can be written.

Rows of one place count as one. Places meet in cells twice as wide as the radius: a place goes to the four cells that its disc may touch, so what is
shuffled goes with the places, until a cell holds so many that several tasks share it. A task cuts a cell into strips of latitude, sorted by longitude. In a
strip a disc holds one range for sure, whose count and minimum are looked up; only the places between that range and the widest one, at the rim, are
measured. Where the crowd is twice as dense, a place meets 1.4 times as many strips and others at its rim.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..arrow import shipped
from ..functions.geo import EARTH_METERS
from ..scratch import stored
from .spatial import DEGREE_METERS, band_cells, cell_number

#: Places of a cell that a task takes at a time, and places whose discs are cut out of a strip at a time.
CHUNK, BLOCK = 500_000, 2048
#: Relative slack of a strip's ranges for rounding.
SLACK = 1e-9
NONE = np.iinfo(np.int64).max


def counted(left: DataFrame, right: DataFrame, meters: float, chunk: int = CHUNK) -> DataFrame:
    """id, n, least: how many ``right`` rows (project, lat, lon, value) lie within ``meters`` of each ``left`` row (project, id, lat, lon), and their least value.

    Left rows without any have no row. A cell with more than ``chunk`` right places is dealt to several tasks, on both sides.
    """
    shipped(left.sparkSession)
    height, band, around = band_cells(2 * meters)
    place, keys = ["project", "lat", "lon"], ["project", "band", "cell"]
    placed = lambda d: d.where("project is not null and lat is not null and lon is not null and not isnan(lat) and not isnan(lon)").withColumn("project", F.col("project").cast("long"))
    left = placed(left).select(*place, "id")
    r = placed(right).groupBy(*place).agg(F.count("*").alias("n"), F.min(F.col("value").cast("long")).alias("value"))
    r = r.select(*[F.col(c).alias(c) for c in (*place, "n", "value")], band(F.col("lat")).alias("band"))  # columns of its own, also beside itself
    r = r.withColumn("cell", cell_number(F.col("lon"), around(F.col("band"))))
    bands = F.array_distinct(F.array(*[F.floor(F.col("lat") / height + d).cast("long") for d in (-0.5, 0.5)]))  # half a cell is as wide as the radius
    l = left.select(*place).distinct().withColumn("band", F.explode(bands)).withColumn("around", around(F.col("band")))  # noqa: E741
    at = lambda d: F.least(F.floor((F.col("lon") + 180) / 360 * F.col("around") + d), F.col("around") - 1).cast("long")
    l = l.withColumn("cell", F.explode(F.array_distinct(F.array(at(-0.5), at(0.5))))).drop("around")  # noqa: E741
    held = stored(r.groupBy(*keys).agg(F.ceil(F.count("*") / chunk).alias("parts")).where("parts > 1"))
    if not held.isEmpty():
        l, r = l.join(held, keys, "left").fillna(1, "parts"), r.join(held, keys, "left").fillna(1, "parts")  # noqa: E741
        own, every = F.pmod(F.xxhash64("lat", "lon"), F.col("parts")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        l = l.withColumn("l_part", own).withColumn("r_part", every).drop("parts")  # noqa: E741
        r = r.withColumn("r_part", own).withColumn("l_part", every).drop("parts")
        keys += ["l_part", "r_part"]
    met = l.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInArrow(_discs(meters), "project bigint, lat double, lon double, n bigint, least bigint")
    return left.join(met.groupBy(*place).agg(F.sum("n").alias("n"), F.min("least").alias("least")), place).select("id", "n", "least")


def _minima(values: np.ndarray) -> np.ndarray:
    """Row k: the least of the 2 ** k values from each place on."""
    rows = [values]
    while 2 ** len(rows) <= len(values):
        step, last = 2 ** (len(rows) - 1), rows[-1]
        rows.append(np.concatenate([np.minimum(last[:-step], last[step:]), last[-step:]]))
    return np.array(rows)


def _discs(meters: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    most = math.sin(min(meters / (2 * EARTH_METERS), math.pi / 2)) ** 2  # the haversine's square at the radius
    margin = meters / DEGREE_METERS * 1.001

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"project": pa.array([], pa.int64()), "lat": pa.array([], pa.float64()), "lon": pa.array([], pa.float64()), "n": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
        project, px, py = (left.column(c).to_numpy() for c in ("project", "lon", "lat"))
        x, y, w, v = (right.column(c).to_numpy() for c in ("lon", "lat", "n", "value"))
        n, least = np.zeros(len(px), np.int64), np.full(len(px), NONE)
        order, across = np.argsort(py), np.lexsort((x, y))
        px, py, x, y, w, v = px[order], py[order], x[across], y[across], w[across], v[across]
        whole = max(px.max(), x.max()) - min(px.min(), x.min()) > 180  # around a pole: no range of longitudes
        cuts = np.unique(np.searchsorted(y, y[np.linspace(0, len(y), max(1, int(math.sqrt(len(y) / 10))), endpoint=False).astype(int)]))  # equal latitudes stay together
        for start, end in zip(cuts, [*cuts[1:], len(y)], strict=True):
            at = start + np.argsort(x[start:end], kind="stable")
            strip = (x[at], y[at], w[at], v[at], np.cos(np.radians(y[at])), np.concatenate([[0], np.cumsum(w[at])]), _minima(v[at]))
            first, last = np.searchsorted(py, [y[start] - margin, y[end - 1] + margin])
            for k in range(first, last, BLOCK):
                some = slice(k, min(k + BLOCK, last))
                _cut(strip, px[some], py[some], n[some], least[some], whole)
        found = n > 0
        return pa.table({"project": project[order][found], "lat": py[found], "lon": px[found], "n": n[found], "least": least[found]})

    def _cut(strip: tuple, px: np.ndarray, py: np.ndarray, n: np.ndarray, least: np.ndarray, whole: bool) -> None:
        """Adds a strip's rows to the counts and minima of some discs."""
        x, y, w, v, cosines, sums, minima = strip
        y1, y2, c1, c2, cos = y.min(), y.max(), cosines.min(), cosines.max(), np.cos(np.radians(py))
        square = lambda d: np.sin(np.radians(d) / 2) ** 2
        wide = most * (1 + SLACK) - square(np.maximum(0, np.maximum(y1 - py, py - y2)))
        sure = most * (1 - SLACK) - square(np.maximum(py - y1, y2 - py))
        reach = lambda left, c: np.degrees(2 * np.arcsin(np.sqrt(np.clip(left / np.maximum(cos * c, 1e-24), 0, 1))))
        far, near = reach(wide, c1) * (1 + SLACK) + 1e-12, reach(sure, c2) * (1 - SLACK) - 1e-12
        a, d = np.searchsorted(x, px - far, "left"), np.searchsorted(x, px + far, "right")
        if whole:
            a, d = np.zeros_like(a), np.full_like(d, len(x))
        b, c = np.searchsorted(x, px - near, "left"), np.searchsorted(x, px + near, "right")
        inner = (sure > 0) & (near > 0) & (b < c) & (not whole)
        a, d = np.where((wide < 0) & (not whole), 0, a), np.where((wide < 0) & (not whole), 0, d)
        b, c = np.where(inner, b, d), np.where(inner, c, d)
        n += sums[c] - sums[b]
        size = c - b
        some = np.flatnonzero(size)
        level = np.frexp(size[some])[1] - 1  # the largest power of two within the range
        least[some] = np.minimum(least[some], np.minimum(minima[level, b[some]], minima[level, c[some] - 2**level]))
        sizes = np.stack([b - a, d - c], 1).ravel()
        per_row = sizes.reshape(-1, 2).sum(1)
        at = np.arange(sizes.sum()) + np.repeat(np.stack([a, c], 1).ravel() - np.cumsum(sizes) + sizes, sizes)
        dy, dx = y[at] - np.repeat(py, per_row), x[at] - np.repeat(px, per_row)
        cc = cosines[at] * np.repeat(cos, per_row)
        s = cc * dx * dx + dy * dy  # sines are as good as their angles, except next to the radius
        edge = most * (math.inf if whole else SLACK + most / max(min(c1, cos.min()), 1e-12) ** 2)
        scale = math.radians(0.5) ** 2
        hit = s <= (most + edge) / scale
        close = np.flatnonzero(hit & (s >= (most - edge) / scale))
        hit[close] = 2 * EARTH_METERS * np.arcsin(np.sqrt(np.minimum(square(dy[close]) + cc[close] * square(dx[close]), 1))) <= meters
        row, at = np.repeat(np.arange(len(px)), per_row)[hit], at[hit]
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        if len(heads):
            n[row[heads]] += np.add.reduceat(w[at], heads)
            least[row[heads]] = np.minimum(least[row[heads]], np.minimum.reduceat(v[at], heads))

    return run
