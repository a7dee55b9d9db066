"""Every operator applied to whole tables. Distances are rounded to 3 decimals, means of coordinates to 5, scores to 9."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import calendar as cal
from ..functions.geo import clamp_radius, haversine
from ..functions.keywords import folder_keywords
from ..functions.labels import country_name, date_range_label, kind_flags
from ..operators import boxes, cards, clusters, discs, filters, ingest, journeys, moments, rollups, sequence, spatial, tags, timeline
from ..scratch import checkpoint_dir, stored
from ..schema import GRID
from ..sources import boundary, inventory
from ..sources import tables as sinks
from ..streaming import streams
from .catalog import boundaries, catalog, crowds, snapshots, table, tag_links

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def m3(c) -> F.Column:
    return F.round(c, 3)


def deg(c) -> F.Column:
    return F.round(c, 5)


def text(c) -> F.Column:
    return F.array_join(c, ",")


# ---------------------------------------------------------------- sessions


def _groups(spark, sf_dir, mode, step):
    return sequence.assign_groups(filters.base(catalog(spark, sf_dir)), mode, sequence.resolve_scale(step))


def _spans(grouped):
    g = grouped.groupBy("project", "group_no").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"), F.count("lat").alias("n_geo"), deg(F.avg("lat")).alias("lat"), deg(F.avg("lon")).alias("lon"))
    return g


@query
def groups_spacetime_trip(spark, sf_dir):
    """Flagship: space-time groups at the default scale."""
    return _spans(_groups(spark, sf_dir, "spacetime", 8))


@query
def groups_time_event(spark, sf_dir):
    return _spans(_groups(spark, sf_dir, "time", 0))


@query
def groups_two_level(spark, sf_dir):
    """The same as the flagship, by windows over days."""
    return _spans(sequence.assign_groups_two_level(filters.base(catalog(spark, sf_dir)), "spacetime", sequence.resolve_scale(8)))


@query
def zoom_group_counts(spark, sf_dir):
    return sequence.zoom_groups(filters.base(catalog(spark, sf_dir)))


@query
def zoom_two_level(spark, sf_dir):
    return sequence.zoom_groups(filters.base(catalog(spark, sf_dir)), two_level=True)


@query
def tracks_two_level(spark, sf_dir):
    """The same as ``journey_tracks``, by windows over days."""
    return journeys.tracks(_tracks(spark, sf_dir, two_level=True)).select("project", "track_no", "start", "end", "n", m3("path_m").alias("path_m"))


@query
def runs_two_level(spark, sf_dir):
    """The same as ``away_runs``, by windows over days."""
    runs = moments.away_runs(filters.base(catalog(spark, sf_dir)), two_level=True)
    return runs.groupBy("project", "run_no", "away", "is_trip").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


@query
def group_cards(spark, sf_dir):
    c = cards.group_cards(_groups(spark, sf_dir, "spacetime", 8), "spacetime")
    return c.select("project", "group_no", "start", "end", "n", "n_geo", "cover_id", deg("lat").alias("lat"), deg("lon").alias("lon"), deg("min_lat").alias("min_lat"), deg("max_lon").alias("max_lon"), "km", text("countries").alias("countries"), text(F.transform("preview_ids", lambda x: x.cast("string"))).alias("preview_ids"), "place", "date_label", "title", "is_geo")


@query
def group_members(spark, sf_dir):
    return _groups(spark, sf_dir, "spacetime", 8).select("project", "group_no", "id")


@query
def group_path_m(spark, sf_dir):
    p = sequence.path_km(_groups(spark, sf_dir, "spacetime", 8), ["project", "group_no"])
    return p.select("project", "group_no", m3("path_m").alias("path_m"))


@query
def preview_ids(spark, sf_dir):
    return sequence.spread_sample(_groups(spark, sf_dir, "spacetime", 8), ["project", "group_no"]).select("project", "group_no", "id")


# ---------------------------------------------------------------- pages, facets, calendar, rollups


@query
def timeline_page1(spark, sf_dir):
    return timeline.timeline_page(catalog(spark, sf_dir)).select("id", "ts", "file_name", "folder_name", "country_code", "camera_model")


@query
def timeline_page2(spark, sf_dir):
    photos = catalog(spark, sf_dir)
    cursor = timeline.next_cursor(timeline.timeline_page(photos))
    return timeline.timeline_page(photos, cursor=cursor).select("id", "ts", "file_name")


@query
def geo_listing(spark, sf_dir):
    return timeline.geo_listing(catalog(spark, sf_dir)).select("id", "file_name", "folder_name", "ts", deg("lat").alias("lat"), deg("lon").alias("lon"), "country_code")


@query
def catalog_totals(spark, sf_dir):
    return timeline.catalog_totals(catalog(spark, sf_dir))


@query
def catalog_fingerprint(spark, sf_dir):
    return timeline.fingerprint(catalog(spark, sf_dir))


def _facet(by):
    return lambda spark, sf_dir: timeline.facets(catalog(spark, sf_dir), by)


QUERIES |= {"facet_country": _facet("country_code"), "facet_camera": _facet("camera_model"), "facet_year": _facet("year")}


@query
def calendar_years(spark, sf_dir):
    return timeline.calendar(catalog(spark, sf_dir))


@query
def calendar_months(spark, sf_dir):
    return timeline.calendar(catalog(spark, sf_dir), "2024")


@query
def calendar_days(spark, sf_dir):
    return timeline.calendar(catalog(spark, sf_dir), "2024", "01")


@query
def calendar_levels(spark, sf_dir):
    return timeline.calendar_levels(catalog(spark, sf_dir))


def _rollup(kind):
    def run(spark, sf_dir):
        r = rollups.rollup_json(rollups.read_rollups(rollups.rollups(catalog(spark, sf_dir)), kind))
        return r

    return run


QUERIES |= {f"rollups_{k}": _rollup(k) for k in ("decade", "year", "month")}


@query
def day_groups(spark, sf_dir):
    return timeline.day_groups(catalog(spark, sf_dir)).select("project", "day", "n", text("countries").alias("countries"))


@query
def filter_search(spark, sf_dir):
    return filters.apply_filters(catalog(spark, sf_dir), search="red%WEEKEND").select("id")


@query
def filter_month_country_camera(spark, sf_dir):
    return filters.apply_filters(catalog(spark, sf_dir), month="2024-01", country="NATION_3", camera="click").select("id")


@query
def filter_day(spark, sf_dir):
    return filters.apply_filters(catalog(spark, sf_dir), year=2024, day="2024-01-15").select("id")


@query
def tag_filter_any(spark, sf_dir):
    photos = catalog(spark, sf_dir)
    return filters.apply_filters(photos, photo_tags=tag_links(photos), tag="Vacation").select("id")


@query
def tag_filter_all(spark, sf_dir):
    photos = catalog(spark, sf_dir)
    return filters.apply_filters(photos, photo_tags=tag_links(photos), tags_all="vacation, red,").select("id")


# ---------------------------------------------------------------- journeys


def _tracks(spark, sf_dir, **kw):
    return journeys.assign_tracks(filters.base(catalog(spark, sf_dir)), **kw)


@query
def journey_tracks(spark, sf_dir):
    return journeys.tracks(_tracks(spark, sf_dir)).select("project", "track_no", "start", "end", "n", m3("path_m").alias("path_m"))


@query
def journey_singles(spark, sf_dir):
    return journeys.singles(_tracks(spark, sf_dir)).select("project", "id", "ts", "country_code")


@query
def journey_stats(spark, sf_dir):
    return journeys.journey_stats(_tracks(spark, sf_dir)).select("project", "photos", "tracks", "standalone", cards.round_half_up(F.col("total_m") / 1000).alias("total_km"))


@query
def track_distance_only(spark, sf_dir):
    return journeys.tracks(_tracks(spark, sf_dir, max_hours=None)).select("project", "track_no", "n", m3("path_m").alias("path_m"))


@query
def track_projection(spark, sf_dir):
    return journeys.track_projection(filters.base(catalog(spark, sf_dir))).select("project", "id", "rank", m3("x").alias("x"), m3("y").alias("y"))


# ---------------------------------------------------------------- moments


def _runs(spark, sf_dir):
    return moments.away_runs(filters.base(catalog(spark, sf_dir)))


@query
def home_country(spark, sf_dir):
    return moments.home_country(filters.base(catalog(spark, sf_dir)))


@query
def home_centroid(spark, sf_dir):
    return moments.home_centroid(filters.base(catalog(spark, sf_dir))).select("project", "home", deg("home_lat").alias("home_lat"), deg("home_lon").alias("home_lon"))


@query
def away_runs(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("project", "run_no", "away", "is_trip").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


@query
def trips(spark, sf_dir):
    return moments.trips(_runs(spark, sf_dir)).select("project", "run_no", "start", "end", "n", "cover_id", text("countries").alias("countries"))


@query
def periods(spark, sf_dir):
    return moments.periods(_runs(spark, sf_dir)).select("project", "kind", "key", "start", "end", "n", "cover_id", text("countries").alias("countries"))


@query
def periods_sparse(spark, sf_dir):
    """A higher bar for weeks, so that both kinds occur."""
    from dataclasses import replace

    return moments.periods(_runs(spark, sf_dir), replace(DEFAULTS, weekly_min_rows=50)).select("project", "kind", "key", "n")


@query
def moments_list(spark, sf_dir):
    return moments.moments(filters.base(catalog(spark, sf_dir))).select("project", "moment_id", "kind", "start", "end", "n", "cover_id")


@query
def trip_stops(spark, sf_dir):
    s = moments.trip_stops(_runs(spark, sf_dir))
    return s.select("project", "run_no", "stop_no", deg("lat").alias("lat"), deg("lon").alias("lon"), "gps", "n", "start", "end", "country", "cover_id")


@query
def stop_assignment(spark, sf_dir):
    runs = stored(_runs(spark, sf_dir))
    return moments.stop_assignment(runs, moments.trip_stops(runs)).groupBy("project", "run_no", "stop_no").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# ---------------------------------------------------------------- tags


@query
def folder_keyword_counts(spark, sf_dir):
    return tags.folder_tags(catalog(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("project").alias("projects"))


@query
def itemsets(spark, sf_dir):
    photos = catalog(spark, sf_dir)
    return tags.tag_itemsets(photos, tag_links(photos))


def _old_links(photos):
    """Stale links: each row's camera and first keyword as automatic tags, ``city`` as a manual one."""
    first = photos.select("project", "id", F.element_at(folder_keywords(F.col("folder_name")), 1).alias("name"), F.lit("automatic").alias("type"))
    camera = photos.select("project", "id", F.col("camera_model").alias("name"), F.lit("automatic").alias("type"))
    manual = photos.where("id % 3 = 0").select("project", "id", F.lit("city").alias("name"), F.lit("manual").alias("type"))
    return first.unionByName(camera).unionByName(manual)


@query
def tag_reconcile(spark, sf_dir):
    photos = catalog(spark, sf_dir)
    return tags.reconcile(photos, _old_links(photos)).groupBy("project", "name", "type").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query
def recommend_top12(spark, sf_dir):
    photos = catalog(spark, sf_dir)
    return tags.recommend_tags(photos, tag_links(photos)).select("project", "id", "name", "score", "k_spatial", "n_spatial", "k_temporal", "n_temporal", "k_folder", "rank")


def _stored_links(photos):
    """The link and tag tables as a catalog stores them: photo_tags and tags, with numbered names; one tag that no row carries."""
    links = tag_links(photos).withColumn("tag_id", F.xxhash64("name"))
    named = links.select("project", "tag_id", "name").distinct().withColumn("type", F.when(F.col("name") == "summer", "manual").otherwise("automatic"))
    unused = photos.select("project", F.xxhash64("camera_model").alias("tag_id"), F.col("camera_model").alias("name")).distinct()
    unused = unused.unionByName(photos.select("project", F.lit(-1).cast("long").alias("tag_id"), F.lit("by hand").alias("name")).distinct())
    unused = unused.withColumn("type", F.when(F.col("tag_id") == -1, "manual").otherwise("automatic"))
    return links.select("project", "id", "tag_id"), named.unionByName(unused)


@query
def photo_tag_names(spark, sf_dir):
    """Every row's tags by name, through the link and tag tables."""
    named = tags.named_links(*_stored_links(catalog(spark, sf_dir)))
    return named.groupBy("project", "id").agg(text(F.array_sort(F.collect_set("name"))).alias("names"), F.count_if(F.col("type") == "manual").alias("by_hand"))


@query
def orphan_tags(spark, sf_dir):
    """What a sweep of the tags deletes: automatic ones that no row carries."""
    photo_tags, named = _stored_links(catalog(spark, sf_dir))
    return tags.orphan_tags(named, tags.named_links(photo_tags, named)).select("project", "name")


@query
def tag_edits(spark, sf_dir):
    """Hand-made changes: every fifth row loses ``vacation``, every third one gets `` Favourite ``, every seventh ``city``."""
    photos = catalog(spark, sf_dir)
    links = tag_links(photos).withColumn("type", F.lit("automatic"))
    edit = lambda n, name, op: photos.where(F.col("id") % n == 0).select("project", "id", F.lit(name).alias("name"), F.lit(op).alias("op"))
    edits = edit(5, "Vacation", "remove").unionByName(edit(3, " Favourite ", "add")).unionByName(edit(7, "city", "add")).unionByName(edit(2, " ", "add"))
    return tags.edit_tags(links, edits).groupBy("project", "name", "type").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query
def catalog_fingerprint_links(spark, sf_dir):
    """The whole fingerprint, with the numbers of tag and cluster links."""
    photos = catalog(spark, sf_dir)
    return timeline.fingerprint(photos, _stored_links(photos)[0], _clustered(spark, sf_dir))


# ---------------------------------------------------------------- space


def _clustered(spark, sf_dir, meters=300.0):
    """project, id, cluster_id: memberships of clusters that are named by their smallest row."""
    return clusters.dbscan(filters.base(catalog(spark, sf_dir)), meters).select("project", "id", F.col("cluster").alias("cluster_id"))


@query
def filter_cluster(spark, sf_dir):
    """The members of the first cluster."""
    links = _clustered(spark, sf_dir)
    first = links.agg(F.min("cluster_id")).first()[0]
    return filters.apply_filters(catalog(spark, sf_dir), photo_clusters=links, cluster=first).select("id")


@query
def neighbour_pairs_clamped(spark, sf_dir):
    """A radius under the allowed range is raised to its lower end."""
    return spatial.neighbour_pairs(filters.base(catalog(spark, sf_dir)), clamp_radius(10)).select("project", "a", "b")


def _old_clusters(old):
    """The clusters table of the members ``old``, at two radii; every third was named by hand."""
    table = old.select("project", F.col("cluster").alias("cluster_id")).distinct().withColumns({
        "name": F.concat(F.lit("Place "), F.col("cluster_id").cast("string")), "type": F.lit("spatial"), "radius_meters": F.lit(300.0), "center_lat": F.lit(0.0), "center_lon": F.lit(0.0),
        "custom_named": F.col("cluster_id") % 3 == 0,
    })
    return table.unionByName(table.withColumns({"cluster_id": F.col("cluster_id") + 10_000_000, "radius_meters": F.lit(500.0)}))


def _snapshot(spark, sf_dir):
    """(next clusters, members, old clusters, old links): the old ones were found without every fourth row."""
    new, old, rows = _two_runs(spark, sf_dir)
    new, old = stored(new), stored(old)
    links = old.select("project", "id", F.col("cluster").alias("cluster_id"))
    links = links.unionByName(links.withColumn("cluster_id", F.col("cluster_id") + 10_000_000))
    matches = clusters.overlaps(new, old).where(F.col("jaccard") > DEFAULTS.stable_jaccard)
    table = stored(_old_clusters(old))
    after = stored(clusters.next_snapshot(clusters.cluster_summary(new, rows), matches, table, 300.0))
    return after, new, table, links


@query
def cluster_snapshot(spark, sf_dir):
    """The clusters table after a run at 300 m: kept ids, names given by hand, new ids; clusters of another radius stay."""
    after, new, old, links = _snapshot(spark, sf_dir)
    table, _ = clusters.replace_radius(old, links, after, new, 300.0)
    return table.select("project", "cluster_id", F.when(F.col("custom_named") | (F.col("radius_meters") == 500), F.col("name")).alias("given_name"), "radius_meters", "custom_named")


@query
def cluster_links(spark, sf_dir):
    """The memberships that go with ``cluster_snapshot``."""
    after, new, old, links = _snapshot(spark, sf_dir)
    return clusters.replace_radius(old, links, after, new, 300.0)[1].select("project", "id", "cluster_id")


@query
def cluster_renames(spark, sf_dir):
    """Every second cluster gets a name by hand."""
    old = stored(_old_clusters(clusters.dbscan(_earlier(filters.base(catalog(spark, sf_dir))), 300)))
    names = old.where("cluster_id % 2 = 0").select("project", "cluster_id", F.concat(F.lit("My "), F.col("cluster_id").cast("string")).alias("name"))
    return tags.rename_clusters(old, names).select("project", "cluster_id", "name", "custom_named")


@query
def neighbour_pairs_300m(spark, sf_dir):
    return spatial.neighbour_pairs(filters.base(catalog(spark, sf_dir)), 300).select("project", "a", "b", m3("meters").alias("meters"))


@query
def temporal_pairs_12h(spark, sf_dir):
    rows = filters.base(catalog(spark, sf_dir))
    return spatial.time_join(rows, rows, 12 * 3600).where("l_id <> r_id").groupBy("project", "l_id").agg(F.count("*").alias("n"))


@query
def temporal_counts_12h(spark, sf_dir):
    """The same as ``temporal_pairs_12h``, without pairs."""
    rows = filters.base(catalog(spark, sf_dir)).select("project", "id", "ts", F.lit(1).cast("long").alias("one"))
    near = spatial.count_within(rows, ["project"], 12 * 3600, "one")
    return near.where("n_within > 1").select("project", F.col("id").alias("l_id"), (F.col("n_within") - 1).alias("n"))


@query
def distance_to_home(spark, sf_dir):
    rows = filters.base(catalog(spark, sf_dir))
    out = rows.where("lat is not null").join(moments.home_centroid(rows), "project")
    return out.select("id", m3(haversine(F.col("lat"), F.col("lon"), F.col("home_lat"), F.col("home_lon"))).alias("meters"))


@query
def clusters_300m(spark, sf_dir):
    return clusters.dbscan(filters.base(catalog(spark, sf_dir)), 300)


@query
def clusters_300m_min4(spark, sf_dir):
    return clusters.dbscan(filters.base(catalog(spark, sf_dir)), 300, 4)


@query
def cluster_summary(spark, sf_dir):
    rows = filters.base(catalog(spark, sf_dir))
    s = clusters.cluster_summary(clusters.dbscan(rows, 300), rows)
    return s.select("project", "cluster", "n", deg("lat").alias("lat"), deg("lon").alias("lon"), text("countries").alias("countries"), text(F.transform("sample_ids", lambda x: x.cast("string"))).alias("sample_ids"))


def _earlier(rows):
    """What an earlier run saw: without every fourth row."""
    return rows.where("id % 4 <> 0")


def _two_runs(spark, sf_dir):
    rows = stored(filters.base(catalog(spark, sf_dir)))
    return clusters.dbscan(rows, 300), clusters.dbscan(_earlier(rows), 300), rows


@query
def cluster_match(spark, sf_dir):
    """Old clusters: of the rows whose id is not divisible by 4."""
    new, old, _ = _two_runs(spark, sf_dir)
    return clusters.overlaps(stored(new), stored(old)).where(F.col("jaccard") > DEFAULTS.stable_jaccard).select("project", "new", "old", "shared", F.round("jaccard", 9).alias("jaccard"))


@query
def cluster_identities(spark, sf_dir):
    new, old, rows = _two_runs(spark, sf_dir)
    return clusters.stable_identities(new, old, rows).select("project", "new", "old", F.round("jaccard", 9).alias("jaccard"), "rule")


@query
def geocode(spark, sf_dir):
    return spatial.geocode(filters.base(catalog(spark, sf_dir)), boundaries(spark)).select("id", "iso")


# ---------------------------------------------------------------- ingest and scalars


@query
def snapshot_actions(spark, sf_dir):
    return ingest.diff_snapshot(*snapshots(spark, sf_dir)).select("path", "id", "action")


@query
def move_matches(spark, sf_dir):
    old, disk = snapshots(spark, sf_dir)
    return ingest.match_moves(ingest.diff_snapshot(old, disk), old).select("id", "old_path", "new_path")


@query
def next_catalog(spark, sf_dir):
    old, disk = snapshots(spark, sf_dir)
    return ingest.apply_actions(old, ingest.diff_snapshot(old, disk)).select("id", "path", "size", "mtime", "content_hash", "status")


@query
def scan_summary(spark, sf_dir):
    old, disk = snapshots(spark, sf_dir)
    actions = ingest.diff_snapshot(old, disk)
    return ingest.scan_summary(actions, ingest.match_moves(actions, old)).select("action", "n")


@query
def duplicates(spark, sf_dir):
    return ingest.duplicates(snapshots(spark, sf_dir)[0])


@query
def retention(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), ((F.col("doc_id") * 7919) % 100003).alias("recency"))
    cap = (docs.agg(F.sum("size")).first()[0] or 0) // 2
    return ingest.retain_within_budget(docs, cap).select("id", "keep")


@query
def utc_normalize(spark, sf_dir):
    rows = catalog(spark, sf_dir)
    wall = cal.parse_wall_time(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    offset = F.when(F.col("camera_model") == "click", "+02:00").when(F.col("camera_model") == "view", "-0730").when(F.col("camera_model") == "purchase", "Z").when(F.col("camera_model") == "signup", "junk")
    utc, minutes = cal.normalize_utc(wall, offset, F.col("lon"))
    return rows.select("id", utc.alias("utc"), cal.format_offset(minutes).alias("tz_offset"))


@query
def offset_parse(spark, sf_dir):
    seconds = F.col("id") % 1600 - 800
    made = F.when(F.col("id") % 7 == 0, F.lit("nope")).otherwise(cal.format_offset(seconds.cast("int")))
    return catalog(spark, sf_dir).select("id", cal.parse_offset(made).alias("minutes"))


@query
def number_texts(spark, sf_dir):
    """Numbers read from odd texts made of the ids."""
    rows = catalog(spark, sf_dir)
    i = F.col("id").cast("string")
    made = F.element_at(F.array(i, F.concat(F.lit(" -"), i, F.lit(".5mm ")), F.concat(F.lit("."), i), F.concat(i, F.lit("e2")), F.concat(F.lit("f/"), i), F.lit(""), F.concat(i, F.lit("/10"))), (F.col("id") % 7 + 1).cast("int"))
    return rows.select("id", cal.number(made).alias("number"))


@query
def wall_times(spark, sf_dir):
    """Wall-clock times read from texts in several forms, some of which are none."""
    rows = catalog(spark, sf_dir)
    at = lambda form: F.date_format("ts", form)
    made = F.element_at(F.array(at("yyyy:MM:dd HH:mm:ss"), at("yyyy-MM-dd'T'HH:mm:ss.SSS"), at("yyyy:MM:dd"), F.concat(at("yyyy:MM:dd"), F.lit(" 25:00:00")), at("yyyy-MM-dd HH:mm:ss'+02:00'")), (F.col("id") % 5 + 1).cast("int"))
    return rows.select("id", cal.parse_wall_time(made).alias("wall"))


@query
def country_labels(spark, sf_dir):
    """Names of country codes: a short form, the boundary data's own name, or the code itself."""
    code = F.element_at(F.array(*map(F.lit, ("US", "FR", "CD", "KR", "DE"))), (F.col("id") % 5 + 1).cast("int"))
    name = F.when(F.col("id") % 2 == 0, F.lit("Data name"))
    return catalog(spark, sf_dir).select(country_name(code, name).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query
def group_labels(spark, sf_dir):
    """Date labels of the groups at the widest time scale."""
    spans = _spans(_groups(spark, sf_dir, "time", 24))
    return spans.select("project", "group_no", date_range_label(F.col("start"), F.col("end")).alias("label"))


@query
def place_name(spark, sf_dir):
    return cards.place_names(_groups(spark, sf_dir, "spacetime", 8), ["project", "group_no"])


@query
def file_kinds(spark, sf_dir):
    made = F.concat(F.regexp_extract("file_name", r"^[^.]*", 0), F.element_at(F.array(*map(F.lit, (".JPG", ".png", ".webp", ".heic", ".txt", ""))), (F.col("id") % 6 + 1).cast("int")))
    rows = catalog(spark, sf_dir).select(*[c.alias(n) for n, c in kind_flags(made).items()])
    return rows.groupBy("format", "writable", "write_back").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- streams, sinks and sources


def _folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/query-{uuid.uuid4().hex}"


@query
def stream_sessions_2h(spark, sf_dir):
    """Sessions of a stream of the events that a watermark of one day has closed."""
    rows = stored(filters.base(catalog(spark, sf_dir)).select("project", "id", "ts"))
    out = _folder(spark)
    live = streams.stream_sessions(spark.readStream.schema(rows.schema).parquet(rows.scratch_path), 7200, "1 day")
    live.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(live.schema).parquet(f"{out}/rows").select("project", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query
def ingest_streamed(spark, sf_dir):
    """The next catalog, by a stream of the listing: the same as ``next_catalog``."""
    old, disk = snapshots(spark, sf_dir)
    listing, state = stored(disk), {"now": old}
    live = spark.readStream.schema(listing.schema).parquet(listing.scratch_path)
    streams.ingest_catalog(live, lambda: state["now"], lambda df: state.update(now=stored(df)), f"{_folder(spark)}/state").awaitTermination()
    return state["now"].select("id", "path", "size", "mtime", "content_hash", "status")


@query
def rollups_touched(spark, sf_dir):
    """Rollups of the periods that a batch falls into, from the whole catalog: the batch holds the first ten projects' errors."""
    photos = catalog(spark, sf_dir)
    touched = streams.touched_rollups(photos, photos.where("project < 10 and camera_model = 'error'"))
    return touched.select("project", "period_type", "period_key", "photo_count")


@query
def rollups_stored(spark, sf_dir):
    """Rollups written as a version of their table, and read again."""
    path = sinks.write_version(rollups.rollups(catalog(spark, sf_dir)), _folder(spark), "period_type")
    return rollups.rollup_json(rollups.read_rollups(spark.read.parquet(path), "month"))


@query
def catalog_stored(spark, sf_dir):
    """The catalog written as its table, and read by the fixed schema."""
    root = _folder(spark)
    sinks.write_table(catalog(spark, sf_dir), root, "photos")
    return sinks.read_table(spark, root, "photos").select("project", "id", "file_name", "ts", "camera_model", "orientation")


@query
def geocode_built(spark, sf_dir):
    """The same as ``geocode``, with boundaries built from GeoJSON, written as a countries file and read again."""
    features = boundaries(spark).withColumn("json", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.concat("ring", F.slice("ring", 1, 1))).alias("coordinates"))))
    features = features.select(F.lit("-").alias("name"), "iso", F.col("json").alias("geometry"))
    each = features.groupBy("iso", "name").agg(F.collect_list(F.from_json("geometry", "coordinates ARRAY<ARRAY<ARRAY<DOUBLE>>>")["coordinates"]).alias("parts"))
    whole = each.select("iso", "name", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.col("parts").alias("coordinates"))).alias("geometry"))
    built = boundary.build_boundaries(whole, tolerance=0.0)
    path = _folder(spark)
    countries = built.groupBy().agg(F.array_sort(F.collect_list(F.struct("iso", "name", "bbox", "polys"))).alias("countries"))
    countries.coalesce(1).write.json(path)
    return spatial.geocode(filters.base(catalog(spark, sf_dir)), boundary.read_boundaries(spark, path)).select("id", "iso")


@query
def filters_off(spark, sf_dir):
    """Empty and zero values turn every predicate off."""
    photos = catalog(spark, sf_dir)
    return filters.apply_filters(photos, photo_tags=tag_links(photos), country="", year=0, month="", day=None, camera="", cluster=0, tag="", tags_all=" , ", search="").select("id")


# ---------------------------------------------------------------- the forms for crowded places, huge groups and changing catalogs


def _crowds(spark, sf_dir):
    return stored(crowds(filters.base(catalog(spark, sf_dir))))


@query
def crowd_clusters(spark, sf_dir):
    """Clusters of crowds by stars, outer rows and boxes."""
    return clusters.dbscan(_crowds(spark, sf_dir), 40, sparse=0)


@query
def crowd_clusters_min6(spark, sf_dir):
    """Clusters of crowds with core rows counted against boxes, and border rows."""
    return clusters.dbscan(_crowds(spark, sf_dir), 25, 6, sparse=0)


@query
def crowd_neighbours(spark, sf_dir):
    """How many rows lie within 60 m of each row of the crowds, and the smallest id among them, without pairs."""
    rows = _crowds(spark, sf_dir)
    return discs.counted(rows, rows.withColumn("value", F.col("id")), 60)


@query
def recommend_by_boxes(spark, sf_dir):
    """The same as ``recommend_top12``, as in crowded places."""
    photos = catalog(spark, sf_dir)
    return tags.recommend_tags(photos, tag_links(photos), sparse=0).select("project", "id", "name", "score", "k_spatial", "n_spatial", "k_temporal", "n_temporal", "k_folder", "rank")


@query
def itemsets_wide(spark, sf_dir):
    """The same as ``itemsets``, with triples counted in prefix groups."""
    photos = catalog(spark, sf_dir)
    return tags.tag_itemsets(photos, tag_links(photos), wide=0)


@query
def preview_ids_ranges(spark, sf_dir):
    """The same as ``preview_ids``, by ranks in ranges of rows."""
    return sequence.spread_sample(_groups(spark, sf_dir, "spacetime", 8), ["project", "group_no"], two_level=True).select("project", "group_no", "id")


@query
def group_cards_two_level(spark, sf_dir):
    """The same as ``group_cards``, without a window over a group."""
    c = cards.group_cards(_groups(spark, sf_dir, "spacetime", 8), "spacetime", two_level=True)
    return c.select("project", "group_no", "start", "end", "n", "n_geo", "cover_id", deg("lat").alias("lat"), deg("lon").alias("lon"), deg("min_lat").alias("min_lat"), deg("max_lon").alias("max_lon"), "km", text("countries").alias("countries"), text(F.transform("preview_ids", lambda x: x.cast("string"))).alias("preview_ids"), "place", "date_label", "title", "is_geo")


@query
def moments_two_level(spark, sf_dir):
    """The same as ``moments_list``, by windows over days."""
    return moments.moments(filters.base(catalog(spark, sf_dir)), two_level=True).select("project", "moment_id", "kind", "start", "end", "n", "cover_id")


@query
def retention_skewed(spark, sf_dir):
    """Half of all rows share one recency, some have none."""
    recency = F.when(F.col("doc_id") % 13 == 0, None).when(F.col("doc_id") % 2 == 0, 77).otherwise((F.col("doc_id") * 7919) % 100003)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("size"), recency.alias("recency"))
    cap = (docs.agg(F.sum("size")).first()[0] or 0) * 3 // 4
    return ingest.retain_within_budget(docs, cap).select("id", "keep")


@query
def geocode_tracks(spark, sf_dir):
    """Points against self-crossing rings of many sides: the tracks of every 50th project, closed."""
    rows = filters.base(catalog(spark, sf_dir))
    vertex = F.array("lon", "lat")
    listed = F.array_sort(F.collect_list(F.struct("ts", "id", vertex.alias("v"))))
    rings = rows.where("lat is not null and project % 50 = 0").groupBy("project").agg(F.transform(listed, lambda x: x["v"]).alias("ring"))
    rings = rings.select(F.col("project").alias("ordinal"), F.concat(F.lit("P"), F.col("project").cast("string")).alias("iso"), "ring")
    return spatial.geocode(rows, rings).select("id", "iso")


@query
def geocode_simplified(spark, sf_dir):
    """The same as ``geocode``, with boundaries whose sides had three more vertices each until they were simplified."""
    sides = F.arrays_zip(F.col("ring").alias("p"), F.concat(F.slice("ring", 2, 1000), F.slice("ring", 1, 1)).alias("q"))
    between = lambda s, t: F.transform(F.arrays_zip(s["p"].alias("u"), s["q"].alias("v")), lambda x: x["u"] * (1 - t) + x["v"] * t)
    dense = F.flatten(F.transform(sides, lambda s: F.array(s["p"], *[between(s, t) for t in (0.25, 0.5, 0.75)])))
    rows = boundaries(spark).withColumn("ring", dense)
    feature = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.concat("ring", F.slice("ring", 1, 1))).alias("coordinates")))
    built = boundary.build_boundaries(rows.select(F.concat(F.lit("N"), F.monotonically_increasing_id().cast("string")).alias("name"), "iso", feature.alias("geometry")))
    ordinals = boundaries(spark).select("iso", "ordinal").distinct()
    return spatial.geocode(filters.base(catalog(spark, sf_dir)), built.join(ordinals, "iso").select("ordinal", "iso", F.explode("polys").alias("ring"))).select("id", "iso")


@query
def rollups_followed(spark, sf_dir):
    """Rollups from counts that followed a stream of changes: rows added, rows taken away, rows that moved to another country and camera."""
    photos = catalog(spark, sf_dir)
    old, gone, new = photos.where("id % 10 = 3"), photos.where("id % 10 = 5"), photos.where("id % 10 = 7")
    now = old.withColumns({"country_code": F.lit("NATION_0"), "camera_model": F.lit("moved")})
    signed = lambda d, added: d.select(*photos.columns, F.lit(added).alias("added"))
    changes = stored(signed(new.unionByName(now), True).unionByName(signed(gone.unionByName(old), False)))
    state = {"now": stored(rollups.rollup_state(photos.where("id % 10 <> 7")))}
    live = spark.readStream.schema(changes.schema).parquet(changes.scratch_path)
    streams.follow_rollups(live, lambda: state["now"], lambda df: state.update(now=stored(df)), f"{_folder(spark)}/state").awaitTermination()
    return rollups.rollup_json(rollups.rollups_of(state["now"]))


@query
def directory_listing(spark, sf_dir):
    """Scan roots, one a source, written as their table and read by its schema."""
    root = _folder(spark)
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("id")).select(F.lit(0).cast("long").alias("project"), "id", F.concat(F.lit("/data/"), "source").alias("path"), F.lit("idle").alias("status"), F.lit(None).cast("timestamp_ntz").alias("last_scanned_at"))
    sinks.write_table(rows, root, "directories")
    return sinks.directories(spark, root).select("project", "id", "path", "status")


@query
def grid_rows(spark, sf_dir):
    """The columns that grids show, of the rows of the stored catalog."""
    root = _folder(spark)
    sinks.write_table(catalog(spark, sf_dir), root, "photos")
    return filters.base(sinks.read_table(spark, root, "photos")).select(*[deg(c).alias(c) if c in ("lat", "lon") else c for c in GRID])


@query
def content_hashes(spark, sf_dir):
    """Hashes of files made of the documents' texts: WebP containers with metadata beside the text, files cut short, and other formats."""
    le = lambda n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(n), 8, "0"), i, 2) for i in (7, 5, 3, 1)]))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))
    even = lambda c: F.when(F.length(c) % 2 == 1, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit("")))
    chunk = lambda kind, body: F.concat(F.encode(F.lit(kind), "utf-8"), le(F.length(body)), body, even(body))
    body = F.concat(F.encode(F.lit("WEBP"), "utf-8"), chunk("EXIF", F.encode(F.col("doc_id").cast("string"), "utf-8")), chunk("VP8 ", F.col("raw")), chunk("XMP ", F.encode(F.lit("note"), "utf-8")))
    webp = F.concat(F.encode(F.lit("RIFF"), "utf-8"), le(F.length(body)), body)
    kind = F.when(F.col("doc_id") % 3 == 0, "webp").when(F.col("doc_id") % 3 == 1, "heic").otherwise("png")
    files = docs.select(F.concat(F.lit("/files/"), F.col("doc_id").cast("string"), F.lit("."), kind).alias("path"), F.when(F.col("doc_id") % 3 == 0, webp).otherwise(F.col("raw")).alias("content"))
    return inventory.content_hashes(files)
