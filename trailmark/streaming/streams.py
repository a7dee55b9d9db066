"""Incremental forms: new files, live sessions, rollups of the touched periods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import period_keys
from ..operators.filters import base
from ..operators.ingest import apply_actions, diff_snapshot
from ..operators.rollups import changed_state, rollups
from ..scratch import stored


def stream_sessions(events: DataFrame, seconds: float, lateness: str = "1 day") -> DataFrame:
    """project, start, end, n of time sessions; a gap of exactly ``seconds`` doesn't break one.

    The session window ends its state once the watermark passes; ``end`` is the last row's time, not the window's end.
    """
    rows = events.withColumn("__t", F.col("ts").cast("timestamp")).withWatermark("__t", lateness)
    grouped = rows.groupBy("project", F.session_window("__t", f"{int(seconds * 1000)} milliseconds").alias("w"))
    return grouped.agg(F.min("__t").alias("start"), F.max("__t").alias("end"), F.count("*").alias("n")).drop("w")


def ingest_stream(listing: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch of new listing rows goes to ``apply``, which runs the batch operators on it (diff, moves, next state)."""
    return listing.writeStream.foreachBatch(lambda batch, _: apply(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_catalog(listing: DataFrame, read: Callable[[], DataFrame], publish: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Keeps a catalog in step with a stream of listings: every micro-batch holds whole listings (project, path, size, mtime, content_hash) of some projects.

    ``read`` gives the current catalog, ``publish`` stores the next one (``write_version`` keeps readers apart). A batch is compared with its
    projects' rows, moves are matched, and the next state joins the rows of all other projects.
    """

    def apply(batch: DataFrame) -> None:
        batch, catalog = stored(batch.dropDuplicates(["project", "path"])), read()
        scanned = batch.select("project").distinct()
        mine, rest = catalog.join(scanned, "project", "left_semi"), catalog.join(scanned, "project", "left_anti")
        after = apply_actions(mine, diff_snapshot(mine, batch))
        publish(after.unionByName(rest.select(*after.columns)))

    return ingest_stream(listing, apply, checkpoint)


def touched_rollups(photos: DataFrame, batch: DataFrame, periods: tuple[str, ...] = ("decade", "year", "month")) -> DataFrame:
    """Rollups of only those periods that a batch of rows falls into, computed from the whole catalog."""
    keys = period_keys(F.col("ts"))
    touched = base(batch).select("project", F.explode(F.array(*[F.struct(F.lit(p).alias("type"), keys[p].alias("key")) for p in periods])).alias("p"))
    touched = touched.select("project", F.col("p.type").alias("period_type"), F.col("p.key").alias("period_key")).distinct()
    widest = touched.where(F.col("period_type") == periods[0]).select("project", F.col("period_key").alias("__key"))
    rows = photos.withColumn("__key", keys[periods[0]]).join(widest, ["project", "__key"], "left_semi").drop("__key")
    return rollups(rows, periods).join(touched, ["project", "period_type", "period_key"], "left_semi")


def follow_rollups(changes: DataFrame, read: Callable[[], DataFrame], publish: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Keeps the counts of ``rollup_state`` in step with a stream of changes: rows of the catalog with ``added`` (false for rows as they were before).

    ``read`` gives the present counts, ``publish`` stores the next ones. Each micro-batch is counted with its sign and merged; the catalog isn't read again.
    """

    def apply(batch: DataFrame) -> None:
        batch = stored(batch)
        publish(changed_state(read(), batch.where("added"), batch.where("not added")))

    return ingest_stream(changes, apply, checkpoint)
