"""Keeping a catalog in step with a file listing: classify, match moves, apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def diff_snapshot(catalog: DataFrame, disk: DataFrame) -> DataFrame:
    """project, path, id, old_status, action and the disk's columns, from one full outer join by path.

    Actions: ``missing`` (gone just now), ``gone`` (missing before, too), ``new``, ``reactivate`` (back and unchanged), ``skip`` (unchanged) and ``update``.
    """
    c = catalog.select("project", "path", "id", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("status").alias("old_status"), F.lit(True).alias("known"))
    d = disk.select("project", "path", "size", "mtime", "content_hash", F.lit(True).alias("listed"))
    same = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    action = (
        F.when(F.col("listed").isNull(), F.when(F.col("old_status") == "missing", "gone").otherwise("missing")).when(F.col("known").isNull(), "new")
        .when(~same, "update").when(F.col("old_status") == "missing", "reactivate").otherwise("skip")
    )
    return c.join(d, ["project", "path"], "full_outer").withColumn("action", action).drop("known", "listed")


def match_moves(actions: DataFrame, catalog: DataFrame) -> DataFrame:
    """project, id, old_path, new_path: new files that take over a missing row with the same content.

    The k-th new path (by path) of a content takes its k-th missing row (by id); rows that went missing in this very scan are among them.
    """
    gone = actions.where(F.col("action").isin("missing", "gone")).select("project", "id").join(catalog, ["project", "id"]).where(F.col("content_hash").isNotNull())
    k = lambda by: F.row_number().over(Window.partitionBy("project", "content_hash").orderBy(by))
    old = gone.select("project", "content_hash", "id", F.col("path").alias("old_path"), k("id").alias("k"))
    new = actions.where("action = 'new' and content_hash is not null").select("project", "content_hash", F.col("path").alias("new_path"), "size", "mtime", k("path").alias("k"))
    return new.join(old, ["project", "content_hash", "k"]).select("project", "id", "old_path", "new_path", "content_hash", "size", "mtime")


def _numbered(rows: DataFrame) -> tuple[DataFrame, Column]:
    """``rows`` and each one's number (1, 2, ...) in its project by path: ranges of paths, with the counts of the ranges before as offsets.

    The ranges are written once, so that counts and rows see the same ones; no window holds more than a range's rows or a project's ranges.
    """
    cut = stored(rows.repartitionByRange("project", "path").withColumn("__range", F.spark_partition_id()))
    counts = cut.groupBy("project", "__range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("project").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("project", "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return cut.join(offsets, ["project", "__range"]), F.col("__before") + F.row_number().over(Window.partitionBy("project", "__range").orderBy("path"))


def apply_actions(catalog: DataFrame, actions: DataFrame) -> DataFrame:
    """The next catalog: project, id, path, size, mtime, content_hash, status. New rows get ids after the project's largest."""
    moves = match_moves(actions, catalog)
    columns = ["project", "id", "path", "size", "mtime", "content_hash", "status"]
    old = catalog.select(*columns).join(moves.select("project", "id"), ["project", "id"], "left_anti")
    done = actions.where("action in ('missing', 'reactivate', 'update')").select("project", "path", "action", F.col("size").alias("s"), F.col("mtime").alias("m"), F.col("content_hash").alias("h"))
    rows = old.join(done, ["project", "path"], "left")
    changed = F.col("action") == "update"
    pick = lambda new, c: F.when(changed, F.col(new)).otherwise(F.col(c)).alias(c)
    status = F.when(F.col("action") == "missing", "missing").when(F.col("action").isNotNull(), "active").otherwise(F.col("status"))
    kept = rows.select("project", "id", "path", pick("s", "size"), pick("m", "mtime"), pick("h", "content_hash"), status.alias("status"))
    moved = moves.select("project", "id", F.col("new_path").alias("path"), "size", "mtime", "content_hash", F.lit("active").alias("status"))
    fresh = actions.where("action = 'new'").join(moves.select("project", F.col("new_path").alias("path")), ["project", "path"], "left_anti")
    top = catalog.groupBy("project").agg(F.max("id").alias("top"))
    fresh, number = _numbered(fresh)
    added = fresh.join(top, "project", "left").select("project", (F.coalesce("top", F.lit(0)) + number).alias("id"), "path", "size", "mtime", "content_hash", F.lit("active").alias("status"))
    return kept.unionByName(moved).unionByName(added)


def scan_summary(actions: DataFrame, moves: DataFrame) -> DataFrame:
    """project, action, n; a move counts as ``moved``, not as ``new``."""
    moved = moves.groupBy("project").agg(F.count("*").alias("n")).select("project", F.lit("moved").alias("action"), "n")
    counted = actions.where("action <> 'gone'").groupBy("project", "action").agg(F.count("*").alias("n"))
    less = counted.join(moved.select("project", F.lit("new").alias("action"), F.col("n").alias("m")), ["project", "action"], "left")
    return less.select("project", "action", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0").unionByName(moved)


def duplicates(files: DataFrame) -> DataFrame:
    """content_hash, n, first_id of contents that several rows hold."""
    return files.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1 and content_hash is not null")


def _boundary(rows: DataFrame, column: str, room: int, buckets: int) -> tuple[int | None, int]:
    """(the largest value of ``column`` at which the sizes from the top exceed ``room``, None if they never do; what is left above it).

    Nested histograms: sizes are summed by bucket, and only the bucket in which the sum passes ``room`` is cut again, until it is one value.
    """
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low is not None:
        width = (high - low) // buckets + 1
        number = column if high - low < 1 << 62 else f"CAST({column} AS DECIMAL(20, 0))"  # a difference may exceed 64 bits
        bucket = F.expr(f"({number} - ({low})) DIV {width}")
        sums = dict(rows.where(F.col(column).between(low, high)).groupBy(bucket.alias("b")).agg(F.sum("size")).collect())  # a bounded number of sums
        for b in sorted(sums, reverse=True):
            if sums[b] > room:
                break
            room -= sums[b]
        else:
            return None, room
        if width == 1:
            return low + b, room
        low, high = low + b * width, min(high, low + (b + 1) * width - 1)
    return None, room


def retain_within_budget(rows: DataFrame, cap: int, buckets: int = 1024) -> DataFrame:
    """``rows`` (id, size, recency; whole numbers) with keep: the most recently used ones whose sizes add up to at most the cap.

    Evicting the least recent until the rest fits keeps exactly the rows from a threshold on, in the order of recency, then id. The threshold is found
    by histograms (``_boundary``), first of recency, then of the ids at its boundary, so no row moves and no order is made, however skewed recency
    is. Rows without recency are the least recent, rows without an id the last of their recency; a null size counts as 0.
    """
    sized = rows.select("id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("recency").cast("long").alias("recency"))
    at, room = _boundary(sized.where("recency is not null"), "recency", cap, buckets)
    same = F.col("recency").cast("long").eqNullSafe(F.lit(at).cast("long"))
    ties = sized.where(same)
    last, room = _boundary(ties.where("id is not null"), "id", room, buckets)
    if last is None:
        unnamed = ties.where("id is null").agg(F.sum("size")).first()[0] or 0
        fits = F.lit(True) if unnamed <= room else F.col("id").isNotNull()
    else:
        fits = F.coalesce(F.col("id") > last, F.lit(False))
    above = F.coalesce(F.col("recency").cast("long") > at, F.lit(False)) if at is not None else F.col("recency").isNotNull()
    return rows.withColumn("keep", above | (same & fits))
