"""Density clusters, and identities that stay with them from run to run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.geo import haversine
from ..scratch import stored
from . import boxes
from .cards import place_names
from .graph import components
from .spatial import neighbour_pairs


def dbscan(photos: DataFrame, meters: float = DEFAULTS.radius_default, min_points: int = 2, sparse: int = 64) -> DataFrame:
    """project, id, cluster (the smallest core id in it) of the clustered rows; noise has none. Ids are unique across projects.

    Core rows have at least ``min_points`` rows within ``meters``, themselves included; clusters are the components of core neighbours. A
    border row goes to the smallest cluster among its core neighbours. At two points every row with a neighbour is core. Clusters need no pairs of
    rows (``boxes.linked_cells``). In a place where a cell, whose rows are all neighbours, holds ``min_points`` rows, all of these are core; the rows of other cells,
    fewer than that each, are counted against boxes (``boxes.near``). Where no cell holds more than ``sparse`` rows, pairs serve.
    """
    if min_points <= 2:
        found = components(boxes.linked_cells(photos, meters, sparse))
        return photos.select("project", "id").join(found.withColumnsRenamed({"node": "id", "root": "cluster"}), "id").select("project", "id", "cluster")
    band, cell, *_ = boxes.cells(meters)
    rows = stored(photos.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("project", "id", "lat", "lon", band.alias("band"), cell.alias("cell")))
    held = stored(rows.groupBy(*boxes.ROOT).agg(F.count("*").alias("n")))
    if (held.agg(F.max("n")).first()[0] or 0) <= sparse:
        return _dbscan_by_pairs(rows, meters, min_points)
    crowd = rows.join(held.where(F.col("n") >= min_points), boxes.ROOT, "left_semi").select("project", "id", "lat", "lon")
    loose = stored(rows.join(held.where(F.col("n") < min_points), boxes.ROOT, "left_semi").select("project", "id", "lat", "lon"))
    few = boxes.boxed(loose, meters)
    counts = boxes.near(few, boxes.boxed(rows, meters), meters).combined(rows.select("id", F.lit(1).alias("value")), F.sum)
    sure = loose.join(counts.where(F.col("value") >= min_points), "id", "left_semi")
    core = stored(crowd.unionByName(sure.select(*crowd.columns)))
    roots = components(boxes.linked_cells(core, meters, sparse))
    clustered = stored(core.join(roots, F.col("id") == F.col("node"), "left").select("project", "id", "lat", "lon", F.coalesce("root", "id").alias("cluster")))
    others = boxes.boxed(loose.join(core, "id", "left_anti"), meters)
    border = boxes.near(others, boxes.boxed(clustered, meters), meters).combined(clustered.select("id", F.col("cluster").alias("value")), F.min)
    border = others.rows.join(border, "id").select("project", "id", F.col("value").alias("cluster"))
    return clustered.select("project", "id", "cluster").unionByName(border)


def _dbscan_by_pairs(photos: DataFrame, meters: float, min_points: int) -> DataFrame:
    pairs = neighbour_pairs(photos, meters).select("project", "a", "b")
    both = stored(pairs.unionByName(pairs.select("project", F.col("b").alias("a"), F.col("a").alias("b"))))
    core = stored(both.groupBy("a").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_points).select(F.col("a").alias("core")))
    to_core = both.join(core, F.col("b") == F.col("core")).select("project", "a", "b")
    inner = to_core.join(core, F.col("a") == F.col("core"), "left_semi")
    roots = components(inner.select("a", "b"))
    clustered = stored(core.join(roots, F.col("core") == F.col("node"), "left").select(F.col("core"), F.coalesce("root", "core").alias("cluster")))
    border = to_core.join(core, F.col("a") == F.col("core"), "left_anti").join(clustered, F.col("b") == F.col("core")).groupBy(F.col("a").alias("core")).agg(F.min("cluster").alias("cluster"))
    every = clustered.unionByName(border.select("core", "cluster"))
    return photos.select("project", "id").join(every, F.col("id") == F.col("core")).select("project", "id", "cluster")


def cluster_summary(members: DataFrame, photos: DataFrame, samples: int = 4) -> DataFrame:
    """project, cluster, n, lat, lon (plain means), countries, sample_ids (the smallest), place; largest first.

    The samples come from ranks inside 64 shares of each cluster, so no window and no list holds a whole cluster.
    """
    rows = members.join(photos, ["project", "id"])
    keys = ["project", "cluster"]
    share = Window.partitionBy(*keys, F.pmod("id", F.lit(64))).orderBy("id")
    ranked = rows.withColumn("__rank", F.row_number().over(share))
    listed = F.array_sort(F.collect_list(F.when(F.col("__rank") <= samples, F.col("id"))))
    out = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.array_sort(F.collect_set("country_code")).alias("countries"),
        F.slice(listed, 1, samples).alias("sample_ids"),
    )
    return out.join(place_names(rows, keys), keys, "left").orderBy(F.col("n").desc(), *keys)


def overlaps(new: DataFrame, old: DataFrame) -> DataFrame:
    """project, new, old, shared, jaccard of clusters that share a member. Inputs: project, id, cluster."""
    sizes = lambda d, name: d.groupBy("project", F.col("cluster").alias(name)).agg(F.count("*").alias(f"n_{name}"))
    n, o = new.withColumnRenamed("cluster", "new"), old.withColumnRenamed("cluster", "old")
    shared = n.join(o, ["project", "id"]).groupBy("project", "new", "old").agg(F.count("*").alias("shared"))
    both = shared.join(sizes(new, "new"), ["project", "new"]).join(sizes(old, "old"), ["project", "old"])
    return both.withColumn("jaccard", F.col("shared") / (F.col("n_new") + F.col("n_old") - F.col("shared")))


def stable_identities(new: DataFrame, old: DataFrame, photos: DataFrame, config=DEFAULTS) -> DataFrame:
    """project, new, old, jaccard, rule: which old cluster each new one continues; each is used once.

    Overlaps above the threshold come first: both sides are partitions, so they are one to one. The rest may match by a small
    shift of the centre and a shared member: best overlap first, then the smallest new and old one. That greedy choice is made in rounds in which
    every pair that is the best of both its sides is taken; each round fixes at least one pair in every group of rivals.
    """
    new, old = stored(new), stored(old)
    found = stored(overlaps(new, old))
    sure = found.where(F.col("jaccard") > config.stable_jaccard).select("project", "new", "old", "jaccard", F.lit("overlap").alias("rule"))
    centre = lambda d, name: d.join(photos.select("project", "id", "lat", "lon"), ["project", "id"]).groupBy("project", F.col("cluster").alias(name)).agg(F.avg("lat").alias(f"{name}_lat"), F.avg("lon").alias(f"{name}_lon"))
    rest = found.join(sure, ["project", "new"], "left_anti").join(sure, ["project", "old"], "left_anti").join(centre(new, "new"), ["project", "new"]).join(centre(old, "old"), ["project", "old"])
    shift = haversine(F.col("new_lat"), F.col("new_lon"), F.col("old_lat"), F.col("old_lon"))
    rivals = rest.where(shift < config.stable_shift).select("project", "new", "old", "jaccard")
    taken = sure
    rivals = stored(rivals)
    while not rivals.isEmpty():
        order = [F.col("jaccard").desc(), F.col("new"), F.col("old")]
        ranks = {f"__{s}": F.row_number().over(Window.partitionBy("project", s).orderBy(*order)) for s in ("new", "old")}
        best = stored(rivals.withColumns(ranks).where("__new = 1 and __old = 1").select("project", "new", "old", "jaccard", F.lit("centre").alias("rule")))
        taken = taken.unionByName(best)
        rivals = stored(rivals.join(best, ["project", "new"], "left_anti").join(best, ["project", "old"], "left_anti"))
    return taken


def next_snapshot(summary: DataFrame, matches: DataFrame, old: DataFrame, meters: float) -> DataFrame:
    """The next clusters table: matched clusters keep their id, and a name given by hand; others get new ids and generated names.

    ``summary``: of the new clusters; ``matches``: of ``stable_identities``; ``old``: project, cluster_id, name, custom_named.
    """
    named = old.select("project", F.col("cluster_id").alias("old"), F.col("name").alias("old_name"), "custom_named")
    rows = summary.join(matches.select("project", F.col("new").alias("cluster"), "old"), ["project", "cluster"], "left").join(named, ["project", "old"], "left")
    top = old.groupBy("project").agg(F.max("cluster_id").alias("top"))
    fresh = F.row_number().over(Window.partitionBy("project", F.col("old").isNull()).orderBy("cluster"))
    out = rows.join(top, "project", "left").withColumn("cluster_id", F.coalesce("old", F.coalesce("top", F.lit(0)) + fresh))
    kept = F.coalesce(F.col("custom_named"), F.lit(False))
    return out.select("project", "cluster", "cluster_id", F.when(kept, F.col("old_name")).otherwise(F.col("place")).alias("name"), F.lit("spatial").alias("type"), F.lit(float(meters)).alias("radius_meters"), F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"), kept.alias("custom_named"))


def snapshot_links(members: DataFrame, snapshot: DataFrame) -> DataFrame:
    """project, id, cluster_id: the memberships that go with ``next_snapshot``. ``members``: project, id, cluster."""
    return members.join(snapshot.select("project", "cluster", "cluster_id"), ["project", "cluster"]).select("project", "id", "cluster_id")


def replace_radius(clusters: DataFrame, links: DataFrame, snapshot: DataFrame, members: DataFrame, meters: float) -> tuple[DataFrame, DataFrame]:
    """(clusters, photo_clusters) after a run at one radius: its spatial clusters and their memberships are replaced, all others stay.

    ``clusters``, ``links``: the stored tables; ``snapshot``: of ``next_snapshot``; ``members``: of ``dbscan``.
    """
    gone = (F.col("type") == "spatial") & (F.col("radius_meters") == float(meters))
    stay = clusters.where(~F.coalesce(gone, F.lit(False)))
    kept = links.join(stay.select("project", "cluster_id"), ["project", "cluster_id"], "left_semi").select("project", "id", "cluster_id")
    return stay.unionByName(snapshot.select(*clusters.columns)), kept.unionByName(snapshot_links(members, snapshot))
