"""Operators over each project's chronological order: sessions at any scale, carried-forward places, path lengths."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.calendar import micros
from ..functions.geo import haversine
from ..scratch import stored

def in_order(*keys: str) -> WindowSpec:
    """Each project's rows in order of time; further keys part them more."""
    return Window.partitionBy("project", *keys).orderBy("ts", "id")


@dataclass(frozen=True)
class Scale:
    step: float
    seconds: float
    meters: float
    tier: str


def resolve_scale(step: float | None = None, config=DEFAULTS) -> Scale:
    """Thresholds of a slider position: anchors spread evenly over the steps, geometric means between them."""
    try:
        s = float(config.default_step if step is None else step)
    except (TypeError, ValueError):
        s = math.nan
    s = min(float(config.steps), max(0.0, s if math.isfinite(s) else float(config.default_step)))
    at = s / config.steps * (len(config.tiers) - 1)
    i = min(len(config.tiers) - 2, int(at))
    a, b, part = config.tiers[i], config.tiers[i + 1], at - i
    between = lambda x, y: math.exp(math.log(x) * (1 - part) + math.log(y) * part)
    return Scale(s, between(a.seconds, b.seconds), between(a.meters, b.meters), config.tiers[math.floor(at + 0.5)].name)


def _place() -> Column:
    return F.when(F.col("lat").isNotNull(), F.struct("lat", "lon"))


def large_projects(photos: DataFrame, rows: int = 2_000_000) -> bool:
    """Whether a project has more rows than one task should order: then the operators below should run with ``two_level``."""
    return (photos.groupBy("project").count().agg(F.max("count")).first()[0] or 0) > rows


def joined(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on ``keys`` in which nulls are equal, as they are to windows and groups."""
    named = other.select(*[F.col(k).alias(f"__on_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in keys]
    return rows.join(named, on).drop(*[f"__on_{k}" for k in keys])


def with_totals(rows: DataFrame, keys: list[str], totals: dict[str, Column], two_level: bool = False) -> DataFrame:
    """``rows`` with aggregates of their group; with ``two_level`` by a join, which can split a large group, else by a window."""
    if two_level:
        return joined(rows, rows.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]), keys)
    return rows.withColumns({n: c.over(Window.partitionBy(*keys)) for n, c in totals.items()})


def carried(rows: DataFrame, lag: dict[str, Column], last: dict[str, Column], two_level: bool = False, w: WindowSpec | None = None, by: tuple[str, ...] = ("project",)) -> DataFrame:
    """``rows`` with columns named by ``lag`` (the previous row's value) and ``last`` (the latest earlier value that isn't null), in the order of each project (of ``by``).

    One level: a window over the project. Two levels, with the same result: windows over days, then over one summary row a day, so that no
    window holds more than a day's rows or a project's days. A day's rows need from before only its last values.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if not two_level:
        w = w or Window.partitionBy(*by).orderBy("ts", "id")
        return rows.withColumns({n: F.lag(c).over(w) for n, c in lag.items()} | {n: F.last(c, True).over(before(w)) for n, c in last.items()})
    keys, at = [*by, "__day"], F.struct("ts", "id")
    rows = rows.withColumn("__day", F.to_date("ts"))
    boxed = {n: F.struct(c.alias("v")) for n, c in lag.items()}  # a previous value may be null
    ends = [F.max_by(c, at).alias(n) for n, c in boxed.items()] + [F.max_by(c, F.when(c.isNotNull(), at)).alias(n) for n, c in last.items()]
    past = before(Window.partitionBy(*by).orderBy("__day"))
    carry = rows.groupBy(*keys).agg(*ends).select(*keys, *[F.last(n, True).over(past).alias(f"{n}__carry") for n in (*lag, *last)])
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    rows = joined(rows.withColumns({n: F.lag(c).over(w) for n, c in boxed.items()} | {n: F.last(c, True).over(before(w)) for n, c in last.items()}), carry, keys)
    both = {n: F.coalesce(n, f"{n}__carry") for n in (*lag, *last)}
    return rows.withColumns({n: c["v"] if n in lag else c for n, c in both.items()}).drop("__day", *[f"{n}__carry" for n in both])


def running_sum(rows: DataFrame, column: str, name: str, two_level: bool = False, w: WindowSpec | None = None) -> DataFrame:
    """``rows`` with the sum of ``column`` up to each row, in each project's order."""
    upto = lambda w: F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not two_level:
        return rows.withColumn(name, upto(w or in_order()))
    keys = ["project", "__day"]
    rows = rows.withColumn("__day", F.to_date("ts"))
    past = Window.partitionBy("project").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys).agg(F.sum(column).alias("n")).select(*keys, F.coalesce(F.sum("n").over(past), F.lit(0)).alias("__offset"))
    inside = rows.withColumn("__inside", upto(Window.partitionBy(*keys).orderBy("ts", "id")))
    return joined(inside, offsets, keys).withColumn(name, F.col("__inside") + F.col("__offset")).drop("__day", "__inside", "__offset")


def _with_before(photos: DataFrame, two_level: bool = False, w: WindowSpec | None = None) -> DataFrame:
    """Of the previous row: its time; of the previous rows: the last place."""
    return carried(photos, {"__prev_t": micros(F.col("ts"))}, {"__prev_place": _place()}, two_level, w)


def _breaks(seconds: float | Column, meters: float | Column | None) -> Column:
    """Whether a row opens a new group: by time, else by distance from the last place; both strictly beyond the threshold."""
    late = micros(F.col("ts")) - F.col("__prev_t") > (seconds if isinstance(seconds, Column) else F.lit(seconds)) * 1e6
    if meters is not None:
        jump = haversine(F.col("__prev_place.lat"), F.col("__prev_place.lon"), F.col("lat"), F.col("lon"))
        late = late | (jump > meters)
    return F.coalesce(late, F.lit(False)).cast("int")


def assign_groups(photos: DataFrame, mode: str = "time", scale: Scale | None = None, keep: tuple[str, ...] = (), two_level: bool = False) -> DataFrame:
    """``photos`` with group_no (0, 1, ... in order of time). Any mode but ``spacetime`` is ``time``.

    One exchange and one sort by project serve the lags, the carried place and the running sum; with ``two_level`` windows over days do (see
    ``carried``). Extra key columns in ``keep`` (such as a scale's step, with columns __seconds and __meters) part the windows further, at one level.
    """
    scale = scale or resolve_scale()
    w = in_order(*keep)
    seconds, meters = (F.col("__seconds"), F.col("__meters")) if keep else (scale.seconds, scale.meters)
    rows = _with_before(photos, two_level, w).withColumn("__break", _breaks(seconds, meters if mode == "spacetime" else None))
    return running_sum(rows, "__break", "group_no", two_level, w).drop("__prev_t", "__prev_place", "__break", "__seconds", "__meters")


def assign_groups_two_level(photos: DataFrame, mode: str = "time", scale: Scale | None = None) -> DataFrame:
    """The same result for projects too large for one task."""
    return assign_groups(photos, mode, scale, two_level=True).select(*photos.columns, "group_no")


def all_scales(spark, config=DEFAULTS) -> DataFrame:
    """step, __seconds, __meters, tier of every slider position."""
    scales = [resolve_scale(i, config) for i in range(config.steps + 1)]
    return spark.createDataFrame([(int(s.step), s.seconds, s.meters, s.tier) for s in scales], "step INT, __seconds DOUBLE, __meters DOUBLE, tier STRING")


def zoom_groups(photos: DataFrame, mode: str = "spacetime", config=DEFAULTS, two_level: bool = False) -> DataFrame:
    """project, step, tier, n_groups for all positions at once.

    The rows are ordered once: each row's gap and jump go to as many breaks as there are scales, counted without another sort.
    """
    seen = _with_before(photos, two_level).select("project", micros(F.col("ts")).alias("t"), "__prev_t", haversine(F.col("__prev_place.lat"), F.col("__prev_place.lon"), F.col("lat"), F.col("lon")).alias("jump"))
    seen = seen.select("project", ((F.col("t") - F.col("__prev_t")) / 1e6).alias("gap"), "jump")
    scales = [resolve_scale(i, config) for i in range(config.steps + 1)]
    far = lambda s: F.coalesce(F.col("jump") > s.meters, F.lit(False)) if mode == "spacetime" else F.lit(False)
    counts = seen.groupBy("project").agg(*[F.sum((F.coalesce(F.col("gap") > s.seconds, F.lit(False)) | far(s)).cast("long")).alias(f"s{i}") for i, s in enumerate(scales)])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s.tier).alias("tier"), (F.col(f"s{i}") + 1).alias("n_groups")) for i, s in enumerate(scales)]))
    return counts.select("project", each.alias("x")).select("project", "x.step", "x.tier", "x.n_groups")


def path_km(rows: DataFrame, keys: list[str], two_level: bool = False) -> DataFrame:
    """keys, path_m: metres along the placed rows of each group, in order; with ``two_level`` over days (see ``carried``)."""
    placed = rows.where(F.col("lat").isNotNull())
    before = carried(placed.select(*keys, "ts", "id", "lat", "lon"), {"__before": F.struct("lat", "lon")}, {}, two_level, by=tuple(keys))
    leg = haversine(F.col("__before.lat"), F.col("__before.lon"), F.col("lat"), F.col("lon"))
    return before.withColumn("__leg", leg).groupBy(*keys).agg(F.coalesce(F.sum("__leg"), F.lit(0.0)).alias("path_m"))


def spread_sample(rows: DataFrame, keys: list[str], n: int = 5, two_level: bool = False) -> DataFrame:
    """At most ``n`` rows of each group, spread evenly over its order, first and last among them.

    With ``two_level`` no window holds a group: rows are written in ranges of their order, the counts of a group's ranges tell which of them hold a wanted
    rank, and only the rows of these are ranked, each range by itself.
    """
    spots = lambda size: F.array_distinct(F.array(*[F.floor(F.lit(i) * (size - 1) / (n - 1) + 0.5).cast("long") for i in range(n)]))
    if not two_level:
        w = Window.partitionBy(*keys).orderBy("ts", "id")
        size = F.count("*").over(Window.partitionBy(*keys))
        ranked = rows.withColumns({"__at": F.row_number().over(w) - 1, "__n": size})
        return ranked.where((F.col("__n") <= n) | F.array_contains(spots(F.col("__n")), F.col("__at").cast("long"))).drop("__at", "__n")
    cut = stored(rows.repartitionByRange(*keys, "ts", "id").withColumn("__range", F.spark_partition_id()))
    counts = cut.groupBy(*keys, "__range").agg(F.count("*").alias("__held"))
    all_ranges, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({"__n": F.sum("__held").over(all_ranges), "__before": F.coalesce(F.sum("__held").over(before), F.lit(0))})
    wanted = F.when(F.col("__n") <= n, F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).otherwise(spots(F.col("__n")))
    inside = F.filter(wanted, lambda x: (x >= F.col("__before")) & (x < F.col("__before") + F.col("__held")))
    holding = offsets.withColumn("__spots", inside).where(F.size("__spots") > 0).select(*keys, "__range", "__before", "__spots")
    ranked = joined(cut, holding, [*keys, "__range"]).withColumn("__at", F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__range").orderBy("ts", "id")) - 1)
    return ranked.where(F.array_contains("__spots", F.col("__at"))).drop("__at", "__before", "__spots", "__range")
