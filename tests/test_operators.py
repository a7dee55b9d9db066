"""Operators on hand-made catalogs, against known results and brute force."""

import contextlib
import itertools
import math
import os
import random
import threading
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trailmark.operators import boxes, cards, clusters, discs, filters, ingest, journeys, moments, rollups, sequence, spatial, tags, timeline
from trailmark.operators.graph import components
from trailmark.scratch import checkpoint_dir, stored

T0 = datetime(2024, 5, 1, 12)
SCHEMA = "project LONG, id LONG, ts TIMESTAMP_NTZ, lat DOUBLE, lon DOUBLE, country_code STRING, folder_name STRING, file_name STRING, camera_model STRING, status STRING"


def photos(spark, rows):
    """rows: dicts; id counts up, everything else has a default."""
    full = [(r.get("project", 1), r.get("id", i), r.get("ts", T0 + timedelta(hours=r.get("h", i))), r.get("lat"), r.get("lon"), r.get("cc"), r.get("folder", "Rome Trip"), f"IMG_{i}.jpg", r.get("camera", "X"), r.get("status", "active")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def pt(lat, lon, **kw):
    return {"lat": float(lat), "lon": float(lon)} | kw


def numbers(df):
    return [r.group_no for r in df.orderBy("project", "ts", "id").collect()]


def scale(seconds, meters=1e9):
    return sequence.Scale(0, seconds, meters, "")


def test_time_gap(spark):
    rows = photos(spark, [{"h": h} for h in (0, 1, 240, 241)])
    assert numbers(sequence.assign_groups(rows, "time", scale(7200))) == [0, 0, 1, 1]
    assert numbers(sequence.assign_groups(rows, "time", scale(30 * 86400))) == [0] * 4


def test_gap_exactly_at_the_threshold_does_not_break(spark):
    assert numbers(sequence.assign_groups(photos(spark, [{"h": 0}, {"h": 2}]), "time", scale(7200))) == [0, 0]


def test_jump(spark):
    paris, rome = (48.85, 2.35), (41.89, 12.49)
    rows = photos(spark, [pt(*paris, h=0), pt(*paris, h=1), pt(*rome, h=2), {"h": 2.5}, pt(*rome, h=3)])
    assert numbers(sequence.assign_groups(rows, "time", scale(6 * 3600, 5e4))) == [0] * 5
    assert numbers(sequence.assign_groups(rows, "spacetime", scale(6 * 3600, 5e4))) == [0, 0, 1, 1, 1]


def random_catalog(spark, seed, n=300, projects=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        p = rnd.randrange(projects)
        place = pt(rnd.choice([10.0, 10.002, 40.0]) + rnd.random() * 0.004, rnd.choice([5.0, 60.0]) + rnd.random() * 0.004) if rnd.random() < 0.7 else {}
        rows.append({"project": p, "ts": T0 + timedelta(minutes=rnd.randrange(60 * 24 * 40)), "cc": rnd.choice(["FR", "IT", None, ""]), "folder": rnd.choice(["Rome Trip", "Paris", None])} | place)
    return photos(spark, rows)


@pytest.mark.parametrize("mode", ["time", "spacetime"])
def test_two_levels_equal_one(spark, mode):
    rows = random_catalog(spark, 1)
    for s in (scale(3600 * 5, 2e5), sequence.resolve_scale(8), scale(60, 10)):
        a, b = (sorted((r.id, r.group_no) for r in f(rows, mode, s).collect()) for f in (sequence.assign_groups, sequence.assign_groups_two_level))
        assert a == b


def test_two_levels_keep_null_keys(spark):
    """Rows without a time or a project are rows of their own group and day, at one level and at two."""
    rows = random_catalog(spark, 5, 150)
    odd = rows.withColumns({"ts": F.when(F.col("id") % 7 != 0, F.col("ts")), "project": F.when(F.col("id") % 11 != 0, F.col("project"))})
    a, b = (sorted((r.id, r.group_no) for r in f(odd, "spacetime", sequence.resolve_scale(8)).collect()) for f in (sequence.assign_groups, sequence.assign_groups_two_level))
    assert a == b and len(a) == 150
    runs = [sorted((r.id, r.away, r.run_no, r.is_trip) for r in moments.away_runs(odd, two_level=two).collect()) for two in (False, True)]
    assert runs[0] == runs[1] and len(runs[0]) == 150


def test_moments_and_cards_at_two_levels(spark):
    rows = random_catalog(spark, 6, 400)
    one, two = (moments.moments(rows, two_level=t).collect() for t in (False, True))
    assert one == two and len(one) > 3
    grouped = sequence.assign_groups(rows, "spacetime")
    shown = [sorted((tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in cards.group_cards(grouped, "spacetime", two_level=t).collect()), key=str) for t in (False, True)]
    assert shown[0] == shown[1]


@pytest.mark.parametrize("n", [2, 5])
def test_spread_samples_by_ranges(spark, n):
    rows = random_catalog(spark, 7, 300).withColumn("group_no", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 20))
    odd = rows.withColumn("project", F.when(F.col("id") % 50 != 3, F.col("project"))).repartition(9)
    a, b = (sorted(r.id for r in sequence.spread_sample(odd, ["project", "group_no"], n, t).collect()) for t in (False, True))
    assert a == b and len(a) > 10


def test_zoom_nests(spark):
    """Boundaries of a wider scale are among those of a narrower one; the counts for all scales agree with each scale alone."""
    rows = random_catalog(spark, 2, 120, 1).cache()
    counts = {r.step: r.n_groups for r in sequence.zoom_groups(rows).collect()}
    before = None
    for step in range(0, 25, 4):
        got = numbers(sequence.assign_groups(rows, "spacetime", sequence.resolve_scale(step)))
        cuts = {i for i in range(1, len(got)) if got[i] != got[i - 1]}
        assert len(cuts) + 1 == counts[step] and (before is None or cuts <= before)
        before = cuts


def test_results_do_not_depend_on_partitions(spark):
    rows = random_catalog(spark, 3)
    want = sorted((r.id, r.group_no) for r in sequence.assign_groups(rows, "spacetime").collect())
    assert sorted((r.id, r.group_no) for r in sequence.assign_groups(rows.repartition(17), "spacetime").collect()) == want


def test_cards(spark):
    rows = photos(spark, [pt(48.85, 2.35, cc="FR", folder="Paris_2024"), {"cc": "IT"}, pt(48.86, 2.36, cc="FR", folder="Paris_2024"), {"cc": ""}])
    (c,) = cards.group_cards(sequence.assign_groups(rows, "spacetime"), "spacetime").collect()
    assert (c.n, c.n_geo, c.cover_id, c.countries, c.km, c.place, c.title, c.preview_ids) == (4, 2, 0, ["FR", "IT"], 1, "Paris, FR", "Paris, FR", [0, 1, 2, 3])


def test_place_names(spark):
    cases = [({"folder": "Tokyo Japan Adventure 2025", "cc": "JP"}, "Tokyo, Japan"), ({"folder": "", "cc": "FR"}, "France"), ({"folder": "", "cc": None}, "Area")]
    names = spark.createDataFrame([("JP", "Japan"), ("FR", "France")], "iso STRING, name STRING")
    for row, want in cases:
        got = cards.place_names(photos(spark, [row, row]).withColumn("group_no", F.lit(0)), ["project", "group_no"], names).collect()
        assert [r.place for r in got] == [want]


def test_spread_sample(spark):
    rows = photos(spark, [{} for _ in range(11)]).withColumn("group_no", F.lit(0))
    assert sorted(r.id for r in sequence.spread_sample(rows, ["project", "group_no"]).collect()) == [0, 3, 5, 8, 10]


def test_timeline_pages(spark):
    rows = photos(spark, [{"h": h // 2} for h in range(7)] + [{"status": "missing"}])
    seen, cursor = [], None
    while True:
        page = timeline.timeline_page(rows, 3, cursor)
        seen += [r.id for r in page.orderBy(F.desc("ts"), F.desc("id")).collect()]
        if not (cursor := timeline.next_cursor(page, 3)):
            break
    assert seen == [6, 5, 4, 3, 2, 1, 0]


def test_facets_keep_undated_rows(spark):
    rows = photos(spark, [{"cc": "FR"}, {"cc": "FR", "ts": None}, {"cc": "IT"}, {"cc": None}, {"cc": "IT", "status": "missing"}])
    assert [tuple(r) for r in timeline.facets(rows, "country_code").collect()] == [("FR", 2), ("IT", 1)]
    t = timeline.catalog_totals(rows).first()
    assert (t.n, t.n_missing) == (3, 1)


def test_calendar(spark):
    rows = photos(spark, [{"ts": datetime(2023, 2, 3)}, {"ts": datetime(2024, 1, 31)}, {"ts": datetime(2024, 2, 1)}, {"ts": datetime(2024, 2, 1, 5)}])
    flat = lambda d: [tuple(r) for r in d.collect()]
    assert flat(timeline.calendar(rows)) == flat(timeline.calendar(rows, month="02")) == [("2024", 3), ("2023", 1)]
    assert flat(timeline.calendar(rows, "2024")) == [("2024-01", 1), ("2024-02", 2)] and flat(timeline.calendar(rows, "2024", "02")) == [("2024-02-01", 2)]
    assert {(r.level, r.key): r.n for r in timeline.calendar_levels(rows).collect()}["month", "2024-02"] == 2


def test_rollups(spark):
    rows = photos(spark, [{"cc": "IT", "camera": "B"}, {"cc": "FR", "camera": "A"}, {"cc": "", "camera": "B"}, {"cc": "FR", "camera": None}, {"ts": None}])
    (r,) = rollups.rollup_json(rollups.read_rollups(rollups.rollups(rows), "decade")).collect()
    assert (r.period_key, r.photo_count, r.countries_list, r.camera_models_counts) == ("2020s", 4, '["FR","IT"]', '{"B":2,"A":1}')
    with pytest.raises(ValueError):
        rollups.read_rollups(rollups.rollups(rows), "week")


def test_filters(spark):
    rows = photos(spark, [{"folder": "Rome_Trip"}, {"folder": "Paris", "cc": "FR"}, {"status": "missing"}, {"ts": None}, {"ts": datetime(2023, 12, 31, 23, 59)}])
    links = spark.createDataFrame([(1, 0, "a"), (1, 0, "b"), (1, 1, "a")], "project LONG, id LONG, name STRING")
    members = spark.createDataFrame([(1, 1, 7)], "project LONG, id LONG, cluster_id LONG")
    ids = lambda **q: sorted(r.id for r in filters.apply_filters(rows, photo_tags=links, photo_clusters=members, **q).collect())
    assert ids() == [0, 1, 4] and ids(country="", year=0) == [0, 1, 4] and ids(country="FR") == [1] and ids(year=2024) == [0, 1] and ids(month="2023-12") == [4] and ids(day="2024-05-01") == [0, 1]
    assert ids(search="ROME") == [0, 4] and ids(search="img__.jp%") == [0, 1, 4] and ids(cluster=7) == [1] and ids(tag="A") == [0, 1] and ids(tags_all=" A, b,") == [0] and ids(camera="Y") == []


def test_journeys(spark):
    rows = photos(spark, [pt(48.85, 2.35, h=0), pt(48.86, 2.35, h=8), pt(48.87, 2.35, h=16.1), {"h": 17}, pt(41.9, 12.5, h=18), pt(41.9, 12.5, h=19)])
    tracks = journeys.assign_tracks(rows)
    assert [r.track_no for r in tracks.orderBy("id").collect()] == [0, 0, 1, 2, 2]
    s = journeys.journey_stats(tracks).first()
    assert (s.photos, s.tracks, s.standalone, round(s.total_m)) == (5, 2, 1, 1112)
    assert journeys.tracks(journeys.assign_tracks(rows, max_hours=None)).count() == 2
    xy = journeys.track_projection(rows.where("id in (4, 5)")).collect()
    assert {(round(r.x, 3), round(r.y, 3)) for r in xy} == {(480.0, 270.0)}


def home_and_trip(spark):
    home = [pt(48.85, 2.35, cc="FR", ts=T0 + timedelta(days=d)) for d in range(10)]
    return photos(spark, home + [pt(41.9, 12.5, cc="IT", ts=datetime(2024, 6, 15, h)) for h in range(8, 19, 2)])


def test_moments(spark):
    rows = home_and_trip(spark)
    assert moments.home_country(rows).first().home == "FR"
    runs = moments.away_runs(rows)
    (trip,) = moments.trips(runs).collect()
    assert trip.n == 6 and trip.countries == ["IT"] and sum(r.n for r in moments.periods(runs).collect()) == 10
    (stop,) = moments.trip_stops(runs).collect()
    assert (stop.n, stop.gps, stop.country, stop.cover_id) == (6, 6, "IT", 10)
    assert [r.kind for r in moments.moments(rows).collect()] == ["trip", "month"]


def test_home_ties_go_to_the_first_seen(spark):
    assert moments.home_country(photos(spark, [{"cc": "IT"}, {"cc": "FR"}, {"cc": "FR"}, {"cc": "IT"}])).first().home == "IT"
    assert moments.home_country(photos(spark, [{}])).first().home is None


def brute_stops(rows):
    """rows: (ts, id, lat, lon, cc) in order."""
    stops = []
    for ts, i, lat, lon, _cc in rows:
        if lat is None:
            if stops:
                stops[-1]["n"] += 1
            continue
        if not stops or meters(lat, lon, stops[-1]["a"] / stops[-1]["g"], stops[-1]["o"] / stops[-1]["g"]) > 25_000:
            stops.append({"a": 0, "o": 0, "g": 0, "n": 0, "first": i})
        s = stops[-1]
        s["a"] += lat
        s["o"] += lon
        s["g"] += 1
        s["n"] += 1
        s["end"] = ts
    return [(s["first"], s["g"], s["n"], s["end"]) for s in stops]


def meters(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6_371_000 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_stops_against_brute_force(spark):
    rnd = random.Random(4)
    made = [({} if rnd.random() < 0.3 else pt(10 + rnd.choice([0, 0.1, 0.24, 0.5, 0.9]), 20.0)) for _ in range(60)]
    rows = photos(spark, made).withColumns({"is_trip": F.lit(True), "run_no": F.lit(0)})
    want = brute_stops([(r.ts, r.id, r.lat, r.lon, None) for r in rows.orderBy("ts", "id").collect()])
    got = moments.trip_stops(rows)
    assert [(r.cover_id, r.gps, r.n, r.end) for r in got.orderBy("stop_no").collect()] == want
    ends = [e for *_, e in want]
    placed = {r.id: r.stop_no for r in moments.stop_assignment(rows, got).collect()}
    for r in rows.collect():
        assert placed[r.id] == next((k for k, e in enumerate(ends) if e >= r.ts), len(ends) - 1)


def test_radius_join_against_brute_force(spark):
    rnd = random.Random(5)
    pts = [(rnd.choice([-89.9995, -45.0, 0.0, 60.0, 89.999]) + rnd.uniform(-0.0005, 0.0005), rnd.choice([-179.9995, 0.0, 179.9995]) + rnd.uniform(-0.004, 0.004)) for _ in range(200)]
    pts = [(max(-90, min(90, a)), max(-180, min(180, b))) for a, b in pts]
    rows = photos(spark, [pt(a, b) for a, b in pts])
    for r in (120.0, 50_000.0):
        near = {(i, j) for i, x in enumerate(pts) for j, y in enumerate(pts) if meters(*x, *y) <= r}
        got = {(x.l_id, x.r_id) for x in spatial.radius_join(rows, rows, r, wrap=True).collect()}
        assert got == near
        flat = {(x.l_id, x.r_id) for x in spatial.radius_join(rows, rows, r).collect()}
        assert flat <= near and all(abs(pts[i][1] - pts[j][1]) > 90 or abs(pts[i][0]) > 89 for i, j in near - flat)


def test_neighbour_pairs_against_all_pairs(spark):
    random.seed(31)
    at = [pt(c + random.uniform(-0.02, 0.02), d + random.uniform(-0.05, 0.05)) for c, d in ((0, 0), (52, 13), (-52, 179.97), (89.99, 40), (-89.99, 10)) for _ in range(60)]
    at += [pt(90, 0), pt(90, 170), pt(0, 180), pt(0, -180), {}, {"lat": 52.0}] + [pt(52, 13)] * 3
    rows = photos(spark, at)
    got = [(r.a, r.b) for r in spatial.neighbour_pairs(rows, 700).collect()]
    want = {(r.l_id, r.r_id) for r in spatial.radius_join(rows, rows, 700).where("l_id < r_id").collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_neighbour_pairs_send_a_row_to_half_its_cells(spark):
    plan = spatial.neighbour_pairs(photos(spark, [pt(1, 1)]), 700)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1  # of five cells; before: of three bands, then of three cells each


def test_components_find_their_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a LONG, b LONG").mapInPandas(counted, "a LONG, b LONG")
    assert {r.root for r in components(edges).collect()} == {0}
    assert read.value == 20


def test_time_join_against_brute_force(spark):
    rnd = random.Random(6)
    hours = [rnd.randrange(0, 200) for _ in range(80)]
    rows = photos(spark, [{"h": h, "project": i % 2} for i, h in enumerate(hours)])
    want = {(i, j) for i in range(80) for j in range(80) if i % 2 == j % 2 and abs(hours[i] - hours[j]) <= 12}
    assert {(r.l_id, r.r_id) for r in spatial.time_join(rows, rows, 12 * 3600).collect()} == want


def test_components_of_a_long_chain(spark):
    order = list(range(1000))
    random.Random(7).shuffle(order)
    edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)) + [(5000, 5001)], "a LONG, b LONG")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1000)} | {5000: 5000, 5001: 5000}


def brute_dbscan(pts, eps, least):
    near = [{j for j, y in enumerate(pts) if meters(*x, *y) <= eps} for x in pts]
    core = {i for i, s in enumerate(near) if len(s) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in label:
                    label[k] = i
                    todo += near[k] & core
    for i in range(len(pts)):
        if i not in core and near[i] & core:
            label[i] = min(label[j] for j in near[i] & core)
    return label


@pytest.mark.parametrize("least", [2, 4])
def test_dbscan_against_brute_force(spark, least):
    rnd = random.Random(8)
    pts = [(10 + rnd.randrange(3) * 0.02 + rnd.random() * 0.008, 20 + rnd.random() * 0.008) for _ in range(60)] + [(50, 50)]
    assert {r.id: r.cluster for r in clusters.dbscan(photos(spark, [pt(*p) for p in pts]), 150, least).collect()} == brute_dbscan(pts, 150, least)


@pytest.mark.parametrize("spread", [0.002, 0.02])
def test_linked_cells_against_all_pairs(spark, spread):
    """The dense way makes the components of all pairs, in crowded and in thin places, near the equator, the pole and the 180th meridian."""
    rnd = random.Random(int(spread * 1e4))
    places = [(0.0, 0.0), (48.0, 2.0), (-0.001, 179.999), (89.999, 10.0), (70.0, -179.9995)]
    rows = [pt(min(90, a + rnd.gauss(0, spread)), min(180, max(-180, b + rnd.gauss(0, 2 * spread))), project=1 + k % 2) for k in range(60) for a, b in places] + [{}]
    table = photos(spark, rows)
    roots = lambda e: {(r.node, r.root) for r in components(e).collect()}
    want = roots(spatial.neighbour_pairs(table, 300).select("a", "b"))
    assert roots(boxes.linked_cells(table, 300, sparse=0)) == want == roots(boxes.linked_cells(table, 300, sparse=10**6))


def crowded(seed, n=260):
    """A crowd with copies of one point, a second one on its rim, a thin scatter, one point at the pole, one without a place."""
    rnd = random.Random(seed)
    pts = [(10 + rnd.random() * 0.002, 20 + rnd.random() * 0.002) for _ in range(n // 2)] + [(10.001, 20.001)] * 20
    pts += [(10.0035 + rnd.random() * 0.0004, 20 + rnd.random() * 0.002) for _ in range(n // 4)]
    pts += [(10 + rnd.random() * 0.02, 20 + rnd.random() * 0.02) for _ in range(n // 4)]
    return [*pts, (50.0, 50.0), (90.0, 3.0), (89.9999, -170.0)]


@pytest.mark.parametrize("leaf", [4, 32])
def test_boxes_against_all_pairs(spark, leaf):
    pts = crowded(3)
    table = photos(spark, [pt(*p) for p in pts] + [{}])
    some = table.where("id % 3 <> 1")
    found = boxes.near(boxes.boxed(some, 150, leaf), boxes.boxed(table, 150, leaf), 150)
    by_hand = [(i, j) for i, a in enumerate(pts) for j, b in enumerate(pts) if i % 3 != 1 and meters(*a, *b) <= 150]
    count = {i: sum(k == i for k, _ in by_hand) for i, _ in by_hand}
    assert {r.id: r.value for r in found.combined(table.select("id", F.lit(1).alias("value")), F.sum).collect()} == count
    least = {i: min(j for k, j in by_hand if k == i and j % 2) for i in count if any(k == i and j % 2 for k, j in by_hand)}
    assert {r.id: r.value for r in found.combined(table.where("id % 2 = 1").select("id", F.col("id").alias("value")), F.min).collect()} == least
    assert found.pairs.count() < len(by_hand) / (3 if leaf == 4 else 1)  # most neighbours are whole boxes


@pytest.mark.parametrize("least", [2, 5])
def test_crowded_dbscan_against_brute_force(spark, least):
    pts = crowded(least)
    got = {r.id: r.cluster for r in clusters.dbscan(photos(spark, [pt(*p) for p in pts] + [{}]), 150, least, sparse=0).collect()}
    assert got == brute_dbscan(pts, 150, least)


@pytest.mark.parametrize(("gap", "n"), [(299.0, 1), (301.0, 2)])
def test_two_crowds_side_by_side(spark, gap, n):
    """Two long crowds whose nearest rows are just within or beyond the radius, everywhere along their sides."""
    degree = 180 / math.pi / 6_371_000
    rows = [pt(10 + (side * gap + (k % 7) * (20 if side else -20)) * degree, 20 + k * 0.25 * degree) for side in (0, 1) for k in range(1500)]
    got = clusters.dbscan(photos(spark, rows), 300)
    assert got.select("cluster").distinct().count() == n and got.count() == 3000


def test_recommendations_in_crowds(spark):
    rnd = random.Random(6)
    rows = [pt(*p, h=rnd.random() * 60, folder=f"Walk {rnd.randrange(4)}", status="missing" if rnd.random() < 0.05 else "active") for p in crowded(9, 120)] + [{"h": 3, "folder": None}]
    table = photos(spark, rows)
    links = spark.createDataFrame([(1, i, t) for i in range(len(rows)) for t in ("sea", "hill", "old", "new", "sun") if rnd.random() < 0.35], "project LONG, id LONG, name STRING")
    columns = ["id", "name", "score", "k_spatial", "n_spatial", "k_temporal", "n_temporal", "k_folder", "rank"]
    by_boxes, by_pairs = (sorted(map(tuple, tags.recommend_tags(table, links, sparse=n).select(*columns).collect())) for n in (0, 10**6))
    assert by_boxes == by_pairs and len(by_boxes) > 50


@pytest.mark.parametrize("leaf", [4, 32])
def test_tags_counted_over_boxes(spark, leaf):
    """By box and row against all pairs: rows that come twice, rows without tags, undated left rows, a row's own tags."""
    rnd = random.Random(leaf)
    pts = crowded(4, 120)
    tags_of = [[t for t in ("hill", "new", "old", "sea") if rnd.random() < 0.4] for _ in pts]
    copies = [2 if i % 9 == 0 else 1 for i in range(len(pts))]
    schema = "id LONG, names ARRAY<STRING>, copies LONG"
    values = spark.createDataFrame(list(zip(range(len(pts)), tags_of, copies)), schema)
    table = photos(spark, [pt(*p) for p in pts]).join(values, "id")
    table = stored(table.unionByName(table.where("copies = 2")))
    tree = boxes.boxed(table.withColumn("dated", F.col("id") % 3 != 1), 150, leaf, ("names", "copies", "dated"))
    found = boxes.near(boxes.Boxes(tree.rows.where("dated"), tree.boxes), tree, 150)
    got = {(r.id, r["name"]): r.value for r in found.tagged(values).collect()}
    want = {}
    for i, a in enumerate(pts):
        for j, b in enumerate(pts):
            if i % 3 != 1 and meters(*a, *b) <= 150:
                for t, n in [(None, copies[j]), *[(t, 1) for t in tags_of[j] if t not in tags_of[i]]]:
                    want[i, t] = want.get((i, t), 0) + copies[i] * copies[j] * n
    assert got == want and len({n for _, n in got}) == 5


def test_roots_meet_as_in_nine_cells(spark):
    """Tiles list fewer rows and miss no pair, near the equator, the poles and the 180th meridian."""
    rnd = random.Random(2)
    places = [(0.0, 0.0), (48.0, 2.0), (89.999, 10.0), (-89.997, -170.0), (-0.001, 179.999), (60.0, -179.999)]
    rows = [pt(max(-90, min(90, a + rnd.gauss(0, 0.004))), max(-180, min(180, b + rnd.gauss(0, 0.01 if abs(a) < 80 else 90))), project=k % 2) for k in range(50) for a, b in places]
    tree = boxes.boxed(photos(spark, rows), 200)
    middles = tree.boxes.where("parent is null").select("box.project", F.col("box").alias("id"), F.expr("(y1 + y2) / 2").alias("lat"), F.expr("(x1 + x2) / 2").alias("lon"))
    want = sorted((r.l_id, r.r_id) for r in spatial.radius_join(middles, middles, 400).select("l_id", "r_id").distinct().collect())
    assert sorted((r.l.box, r.r.box) for r in boxes.root_pairs(tree, tree, 200).collect()) == want and len(want) > 1000


def written(spark, run):
    """Bytes of the shuffle files that ``run`` writes, also of those that Spark drops meanwhile, and of the scratch tables that it leaves."""
    local = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    found, over = {}, threading.Event()

    def look(known):
        for d in local:
            for at, _, names in os.walk(d):
                for f in names:
                    if f.startswith("shuffle_") and f.endswith(".data") and f not in known:
                        with contextlib.suppress(OSError):
                            found[f] = os.path.getsize(f"{at}/{f}")

    def watch(known):
        while not over.wait(0.2):
            look(known)

    look({})
    old, tables = {*found}, {*Path(checkpoint_dir(spark)).rglob("*.parquet")}
    found.clear()
    thread = threading.Thread(target=watch, args=(old,))
    thread.start()
    try:
        run()
    finally:
        over.set()
        thread.join()
    look(old)
    return sum(found.values()), sum(f.stat().st_size for f in Path(checkpoint_dir(spark)).rglob("*.parquet") if f not in tables)


def test_recommendations_write_little(spark):
    """Thin places, tags and quarters of a row are not listed again and again: disk in bytes a row, with joins by shuffle as in large tables."""
    rnd = random.Random(8)
    rows = [pt(10 + rnd.random() * 0.2, 20 + rnd.random() * 0.2, h=rnd.random() * 700, folder=f"Walk {i // 3}", project=i % 20) for i in range(6000)]
    table = stored(photos(spark, rows))
    links = stored(spark.createDataFrame([(i % 20, i, t) for i in range(len(rows)) for t in rnd.sample("abcdefghijklmnopqrst", 5)], "project LONG, id LONG, name STRING"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    try:
        shuffled, kept = written(spark, lambda: tags.recommend_tags(table, links, sparse=0).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert shuffled < 1500 * len(rows) and kept < 120 * len(rows)  # before: 3210 and 260


def test_count_within(spark):
    rows = photos(spark, [{"h": h} for h in (0, 0, 1, 12, 13, 24, 25.5, 60)] + [{"project": 2, "h": 3}]).withColumn("w", F.lit(1))
    got = {r.id: r.n_within for r in spatial.count_within(rows, ["project"], 12 * 3600, "w").collect()}
    assert got == {0: 4, 1: 4, 2: 5, 3: 6, 4: 4, 5: 4, 6: 2, 7: 1, 8: 1}


def test_stretches_list_few_rows_twice(spark):
    rows = photos(spark, [{"h": i * 0.5} for i in range(2000)]).withColumn("one", F.lit(1).cast("long"))
    assert spatial.in_stretches(rows, int(12 * 3600e6)).count() <= 1.4 * 2000  # before: three times
    got = {r.id: r.n_within for r in spatial.count_within(rows, ["project"], 12 * 3600, "one").collect()}
    assert got == {i: min(i + 24, 1999) - max(i - 24, 0) + 1 for i in range(2000)}


def test_quarters_are_spread_after_the_last_shuffle(spark):
    rows = photos(spark, [{"h": h} for h in (0, 1, 5, 40)])
    q = tags._quarters(rows, 12 * 3600, 4, ["project"])
    plan = q._jdf.queryExecution().sparkPlan().toString()
    before = q._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Generate" in plan and "Exchange" not in before  # before: nine rows a quarter were shuffled
    assert q.agg(F.sum("n")).first()[0] == 9 * 4


def test_links_through_stored_tables(spark):
    photo_tags = spark.createDataFrame([(1, 7, 2), (1, 7, 1), (1, 8, 1), (2, 7, 1)], "project LONG, id LONG, tag_id LONG")
    named = spark.createDataFrame([(1, 1, "sea", "manual"), (1, 2, "hill", "automatic"), (2, 1, "town", "manual")], "project LONG, tag_id LONG, name STRING, type STRING")
    assert [r.name for r in tags.tags_of(photo_tags, named, 1, 7).collect()] == ["hill", "sea"] and tags.tags_of(photo_tags, named, 3, 7).count() == 0
    assert sorted(tuple(r) for r in tags.named_links(photo_tags, named).collect()) == [(1, 7, "hill", "automatic"), (1, 7, "sea", "manual"), (1, 8, "sea", "manual"), (2, 7, "town", "manual")]


def test_two_clusters_and_noise(spark):
    near = lambda a, b: [pt(a + d, b) for d in (0, 0.0005, 0.001)]
    rows = photos(spark, near(48.858, 2.294) + near(41.89, 12.492) + [pt(50, 50)])
    s = clusters.cluster_summary(clusters.dbscan(rows, 300), rows).collect()
    assert [(r.n, r.sample_ids) for r in s] == [(3, [0, 1, 2]), (3, [3, 4, 5])]


def test_stable_identities(spark):
    member = "project LONG, id LONG, cluster LONG"
    new = spark.createDataFrame([(1, i, 100) for i in range(4)] + [(1, i, 200) for i in range(10, 13)] + [(1, 50, 300)], member)
    old = spark.createDataFrame([(1, i, 7) for i in range(3)] + [(1, 12, 8), (1, 13, 8), (1, 14, 8), (1, 15, 8)], member)
    rows = photos(spark, [pt(10.0, 20.0, id=i) for i in range(60)])
    got = {r.new: (r.old, r.rule) for r in clusters.stable_identities(new, old, rows).collect()}
    assert got == {100: (7, "overlap"), 200: (8, "centre")}
    summary = clusters.cluster_summary(new, rows)
    before = spark.createDataFrame([(1, 7, "Mine", True), (1, 8, "Auto", False)], "project LONG, cluster_id LONG, name STRING, custom_named BOOLEAN")
    after = {r.cluster: (r.cluster_id, r.name) for r in clusters.next_snapshot(summary, clusters.stable_identities(new, old, rows), before, 300).collect()}
    assert after == {100: (7, "Mine"), 200: (8, "Rome"), 300: (9, "Rome")}


def test_tags(spark):
    rows = photos(spark, [{"folder": "Rome Summer"}, {"folder": "Rome"}, {"folder": "Rome", "status": "missing"}])
    links = spark.createDataFrame([(1, 0, "rome", "automatic"), (1, 0, "stale", "automatic"), (1, 1, "summer", "manual"), (1, 2, "stale", "automatic")], "project LONG, id LONG, name STRING, type STRING")
    got = sorted(tuple(r)[1:] for r in tags.reconcile(rows, links).collect())
    assert got == [(0, "rome", "automatic"), (0, "summer", "manual"), (1, "rome", "automatic"), (1, "summer", "manual"), (2, "stale", "automatic")]
    edits = spark.createDataFrame([(1, 0, " New ", "add"), (1, 0, "rome", "remove"), (1, 0, "new", "add"), (1, 1, "summer", "add")], "project LONG, id LONG, name STRING, op STRING")
    assert sorted(tuple(r)[1:] for r in tags.edit_tags(links, edits).collect()) == [(0, "new", "manual"), (0, "stale", "automatic"), (1, "summer", "manual"), (2, "stale", "automatic")]


def test_reconcile_finds_its_links_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = photos(spark, [{"folder": "Rome Trip"}, {"folder": "Oslo"}, {"status": "missing"}])
    schema = "project LONG, id LONG, name STRING, type STRING"
    links = spark.createDataFrame([(1, 0, "rome", "automatic"), (1, 0, "stale", "automatic"), (1, 1, "trip", "manual"), (1, 2, "kept", "automatic")], schema).mapInPandas(counted, schema)
    got = sorted((r.id, r.name, r.type) for r in tags.reconcile(rows, links).collect())
    assert got == [(0, "rome", "automatic"), (0, "trip", "manual"), (1, "oslo", "automatic"), (1, "trip", "manual"), (2, "kept", "automatic")]
    assert read.value == 4


def test_itemsets(spark):
    rows = photos(spark, [{} for _ in range(10)])
    baskets = [("a", "b", "c")] * 3 + [("a", "b")] * 2 + [("d", "a")]
    links = spark.createDataFrame([(1, i, t) for i, b in enumerate(baskets) for t in b], "project LONG, id LONG, name STRING")
    assert [(r["items"], r["n"], r["total"]) for r in tags.tag_itemsets(rows, links).collect()] == [("a+b", 5, 10), ("a+c", 3, 10), ("b+c", 3, 10), ("a+b+c", 3, 10)]


def test_wide_itemsets(spark):
    """Rows of many tags, among them one of 2,000, take prefix groups with the same counts."""
    rnd = random.Random(3)
    baskets = [[f"t{k}" for k in rnd.sample(range(30), rnd.randrange(1, 25))] for _ in range(80)]
    baskets[7] = sorted({*baskets[7], *(f"t{k}" for k in range(2000))})
    rows = photos(spark, [{} for _ in range(90)])
    links = spark.createDataFrame([(1, i, t) for i, b in enumerate(baskets) for t in b], "project LONG, id LONG, name STRING")
    counts = {}
    for b in baskets:
        kept = sorted(t for t in b if int(t[1:]) < 30)
        for size in (2, 3):
            for c in itertools.combinations(kept, size):
                counts[c] = counts.get(c, 0) + 1
    want = sorted(((-n, len(c), "+".join(c)) for c, n in counts.items() if n >= 5))[:400]
    for wide, salts in ((64, 4), (3, 2), (0, 1)):
        got = [(-r["n"], r["size"], r["items"]) for r in tags.tag_itemsets(rows, links, top=400, wide=wide, salts=salts).collect()]
        assert got == want


def test_recommendations(spark):
    rows = photos(spark, [pt(10, 20, h=0, folder="A"), pt(10, 20, h=1, folder="A"), pt(10, 20, h=500, folder="B"), {"h": 505, "folder": "B"}])
    links = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "project LONG, id LONG, name STRING")
    got = {(r.id, r["name"]): r.score for r in tags.recommend_tags(rows, links).collect()}
    assert got == {(0, "x"): pytest.approx(0.25 + 0.3 + 0.2), (0, "y"): 0.25, (1, "y"): 0.25, (2, "x"): 0.25, (3, "y"): 0.5}


def listing(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "project LONG, path STRING, size LONG, mtime LONG, content_hash STRING")


def test_snapshot(spark):
    catalog = spark.createDataFrame(
        [(1, 1, "a", 1, 1, "h1", "active"), (1, 2, "b", 1, 1, "h2", "active"), (1, 3, "c", 1, 1, "h2", "active"), (1, 4, "d", 1, 1, "h4", "missing"), (1, 5, "e", 1, 1, "h5", "active"), (1, 6, "f", 1, 1, "h6", "missing")],
        "project LONG, id LONG, path STRING, size LONG, mtime LONG, content_hash STRING, status STRING",
    )
    disk = listing(spark, [("a", 1, 1, "h1"), ("d", 1, 1, "h4"), ("e", 2, 1, "h5x"), ("n/2", 1, 1, "h2"), ("n/1", 1, 1, "h2"), ("n/3", 1, 1, "h2"), ("n/9", 1, 1, "h9")])
    actions = ingest.diff_snapshot(catalog, disk)
    assert {r.path: r.action for r in actions.collect()} == {"a": "skip", "b": "missing", "c": "missing", "d": "reactivate", "e": "update", "f": "gone", "n/1": "new", "n/2": "new", "n/3": "new", "n/9": "new"}
    moves = ingest.match_moves(actions, catalog)
    assert {(r.id, r.new_path) for r in moves.collect()} == {(2, "n/1"), (3, "n/2")}
    after = ingest.apply_actions(catalog, actions)
    assert {(r.id, r.path, r.content_hash, r.status) for r in after.collect()} == {(1, "a", "h1", "active"), (2, "n/1", "h2", "active"), (3, "n/2", "h2", "active"), (4, "d", "h4", "active"), (5, "e", "h5x", "active"), (6, "f", "h6", "missing"), (7, "n/3", "h2", "active"), (8, "n/9", "h9", "active")}
    assert {r.action: r.n for r in ingest.scan_summary(actions, moves).collect()} == {"skip": 1, "missing": 2, "reactivate": 1, "update": 1, "new": 2, "moved": 2}
    assert {r.action for r in ingest.diff_snapshot(after, disk).collect()} <= {"skip", "gone"}  # a second scan finds nothing to do
    assert [tuple(r) for r in ingest.duplicates(catalog).collect()] == [("h2", 2, 2)]


def test_retention_against_eviction(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(1, 50), rnd.randrange(1000)) for i in range(200)]
    total, kept = sum(s for _, s, _ in rows), {i for i, *_ in rows}
    for i, s, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if total <= 2000:
            break
        total -= s
        kept.discard(i)
    got = ingest.retain_within_budget(spark.createDataFrame(rows, "id LONG, size LONG, recency LONG"), 2000, buckets=7)
    assert {r.id for r in got.where("keep").collect()} == kept


def test_retention_of_skewed_and_odd_rows(spark):
    """Nearly all rows of one recency, extremes of the range, null recency, null size, null id."""
    rows = [(i, 3, 500) for i in range(300)] + [(300, 5, -(2**63)), (301, 5, 2**63 - 1), (302, None, 500), (303, 4, None), (304, 4, None), (None, 2, 500), (305, 0, 499), (306, 7, None)]
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0] is not None, r[0] or 0), reverse=True)
    table = spark.createDataFrame(rows, "id LONG, size LONG, recency LONG")
    for cap in (0, 4, 5, 100, 500, 904, 905, 906, 907, 908, 912, 914, 918, 922, 926, 10**6):
        total, kept = 0, set()
        for i, s, _ in order:
            total += s or 0
            if total > cap:
                break
            kept.add(i)
        got = ingest.retain_within_budget(table, cap, buckets=10)
        assert got.count() == len(rows) and {r.id for r in got.where("keep").collect()} == kept, cap
    assert ingest.retain_within_budget(table.limit(0), 5).count() == 0


def in_ring(x, y, ring):
    odd = False
    for (a, b), (c, d) in zip(ring, [ring[-1], *ring[:-1]]):
        if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
            odd = not odd
    return odd


def test_geocode_by_tiles(spark):
    """Star-shaped, overlapping and tiny rings against the ring test of every point; points on sides and corners, too."""
    rnd = random.Random(12)
    rings = []
    for k in range(14):
        x, y, r = rnd.uniform(-170, 170), rnd.uniform(-80, 80), rnd.choice([0.01, 0.5, 9, 40])
        n = rnd.randrange(3, 90)
        rings.append((k // 2, f"C{k // 2}", [[x + r * rnd.uniform(0.3, 1) * math.cos(6.2832 * i / n), y + r * rnd.uniform(0.3, 1) * math.sin(6.2832 * i / n)] for i in range(n)]))
    rings += [(8, "SQ", [[0.0, 0.0], [16.0, 0.0], [16.0, 16.0], [0.0, 16.0], [0.0, 0.0]]), (9, "IN", [[2.0, 2.0], [10.0, 2.0], [10.0, 10.0]])]
    near = [(v[0] + rnd.gauss(0, 0.02), v[1] + rnd.gauss(0, 0.02)) for _, _, ring in rings for v in ring[:6]] + [tuple(v) for _, _, ring in rings for v in ring[:3]] + [(8.0, 8.0), (16.0, 3.0), (3.0, 16.0), (1.0, 1.0)]
    pts = near + [(rnd.uniform(-180, 180), rnd.uniform(-90, 90)) for _ in range(400)]
    table = spark.createDataFrame(rings, "ordinal INT, iso STRING, ring ARRAY<ARRAY<DOUBLE>>")
    want = {}
    for i, (x, y) in enumerate(pts):
        inside = [(o, iso) for o, iso, ring in rings if in_ring(x, y, ring)]
        if inside:
            want[i] = min(inside)[1]
    points = photos(spark, [pt(y, x) for x, y in pts] + [{}])
    assert {r.id: r.iso for r in spatial.geocode(points, table).collect()} == want and len(want) > 100
    tiles = spatial.boundary_tiles(table.withColumn("ring_no", F.monotonically_increasing_id())).collect()
    assert all(f.ring_no is None for t in tiles for f in t.found[-1:]) or any(t.found[0].ring_no is None for t in tiles)
    assert spatial.geocode(points, table.limit(0)).count() == 0


def test_rollups_follow_changes(spark):
    rows = random_catalog(spark, 10, 300)
    before, gone, new = rows.where("id < 220"), rows.where("id < 220 and id % 9 = 0"), rows.where("id >= 220")
    old = before.where("id % 9 = 4")  # updated: another country, camera and time
    now = old.withColumns({"country_code": F.lit("ES"), "camera_model": F.lit("Z"), "ts": F.col("ts") + F.expr("INTERVAL 400 DAYS")})
    state = rollups.changed_state(rollups.rollup_state(before), new.unionByName(now), gone.unionByName(old))
    after = before.where("id % 9 not in (0, 4)").unionByName(now).unionByName(new)
    plain = lambda d: sorted(str(r) for r in d.select("project", "period_type", "period_key", "photo_count", "countries", "cameras").collect())
    assert plain(rollups.rollups_of(state)) == plain(rollups.rollups(after))
    assert rollups.changed_state(state, rows.limit(0), after).count() == 0  # all gone: nothing is left


def test_geocode(spark):
    from trailmark.plans.catalog import boundaries

    where = {(-100.0, -30.0): "AA", (10.0, -30.0): "BB", (20.0, 0.0): "CC", (-10.0, 5.0): "BB", (115.0, 20.0): None, (130.0, 20.0): "DD", (-110.0, 40.0): "EE", (30.0, 60.0): "FF"}
    rows = photos(spark, [pt(lat, lon) for lon, lat in where] + [{}])
    got = {r.id: r.iso for r in spatial.geocode(rows, boundaries(spark)).collect()}
    assert [got.get(i) for i in range(len(where))] == list(where.values())


def test_empty_catalog(spark):
    none = photos(spark, [{}]).limit(0)
    for df in (sequence.assign_groups(none), sequence.zoom_groups(none), moments.moments(none), rollups.rollups(none), timeline.catalog_totals(none), journeys.journey_stats(journeys.assign_tracks(none)), clusters.dbscan(none, 300)):
        assert df.count() == 0


@pytest.mark.parametrize(("centre", "chunk"), [((10.0, 20.0), 200_000), ((-63.4, -179.9995), 100), ((0.0, 179.9995), 100), ((89.9995, 5.0), 200_000)])
def test_discs_against_all_pairs(spark, centre, chunk):
    rnd = random.Random(4)
    wide = 1 / max(math.cos(math.radians(centre[0])), 0.01)
    pts = [(min(centre[0] + rnd.uniform(0, 0.003), 90.0), min(centre[1] + rnd.uniform(0, 0.003) * wide, 180.0)) for _ in range(500)]
    pts += [pts[7]] * 40 + [(centre[0], min(centre[1] + k * 0.0001, 180.0)) for k in range(20)]
    table = photos(spark, [pt(*p, project=1 + (i % 5 == 0)) for i, p in enumerate(pts)] + [{}, pt(centre[0], float("nan"))])
    some = table.where("id % 3 <> 1")
    near = {i: [j for j, b in enumerate(pts) if (i % 5 == 0) == (j % 5 == 0) and meters(*a, *b) <= 60] for i, a in enumerate(pts) if i % 3 != 1}
    got = {r.id: (r.n, r.least) for r in discs.counted(some, table.withColumn("value", -F.col("id")), 60, chunk).collect()}
    assert got == {i: (len(js), -max(js)) for i, js in near.items() if js}


def test_discs_write_no_neighbours(spark):
    """Rows of one place count as one, and neither neighbours nor rows at the rim meet in a join: its only one brings the places' counts to the rows."""
    rows = spark.range(6000).select(F.lit(1).alias("project"), "id", (10 + (F.col("id") % 77) * 1e-5).alias("lat"), (20 + (F.col("id") % 83) * 1e-5).alias("lon"))
    found = discs.counted(rows, rows.withColumn("value", F.col("id")), 60)
    assert found.count() == 6000 and found.agg(F.sum("n")).first()[0] > 6000 * 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.split("\n")) == 1


def test_rows_with_the_same_tags_count_as_one_set(spark):
    """Sets of frequent tags are kept once with their number of rows; rows without a date, links of other rows, repeated links and rare tags don't count."""
    rows = photos(spark, [{} for _ in range(60)]).withColumn("ts", F.when(F.col("id") < 50, F.col("ts")))
    links = [(1, i, t) for i in range(60) for t in (("sea", "sun", "hill"), ("sun", "sea"))[i % 2]] + [(1, 0, "sea"), (1, 3, "rare"), (2, 3, "sea"), (1, 900, "sea"), (1, 4, None)]
    table = spark.createDataFrame(links, "project LONG, id LONG, name STRING")
    sets = tags.tag_sets(rows.where("ts is not null").select("project", "id"), table, 3)
    assert sorted((tuple(r.names), r.n) for r in sets.collect()) == [(("hill", "sea", "sun"), 25), (("sea", "sun"), 25)]
    want = [("sea+sun", 50, 50), ("hill+sea", 25, 50), ("hill+sun", 25, 50), ("hill+sea+sun", 25, 50)]
    for wide in (0, 64):
        assert [(r["items"], r.n, r.total) for r in tags.tag_itemsets(rows, table, wide=wide).collect()] == want


def test_geocode_tests_few_of_many_rings(spark, monkeypatch):
    """Sixty rings over each other: the first one that holds a point is found, and points that it holds don't meet the others."""
    rnd = random.Random(5)
    rings = [(k, f"R{k}", [[20 + rnd.random() * 0.05, 10 + rnd.random() * 0.05] for _ in range(3 if k else 40)]) for k in range(60)]
    rings[1] = (1, "R1", [[19.9, 9.9], [20.1, 9.9], [20.1, 10.1], [19.9, 10.1]])
    pts = [(19.99 + rnd.random() * 0.07, 9.99 + rnd.random() * 0.07) for _ in range(300)]
    table = spark.createDataFrame(rings, "ordinal INT, iso STRING, ring ARRAY<ARRAY<DOUBLE>>")
    points = photos(spark, [pt(y, x, project=None if i % 9 == 0 else 1) for i, (x, y) in enumerate(pts)])
    rounds, keep = [], spatial.stored
    monkeypatch.setattr(spatial, "stored", lambda df: rounds.append(keep(df)) or rounds[-1])
    for listed in (table, table.where("ordinal <> 1")):
        some = [(o, iso, ring) for o, iso, ring in rings if o != 1 or listed is table]
        want = {i: next((iso for _, iso, ring in some if in_ring(x, y, ring)), None) for i, (x, y) in enumerate(pts)}
        rounds.clear()
        found = spatial.geocode(points, listed)
        assert sorted((r.id, r.iso) for r in found.collect()) == sorted((i, iso) for i, iso in want.items() if iso)
        left = [r.count() for r in rounds if "first" in r.columns]
        assert len(left) == 1 if listed is table else left[1] < left[0]  # before: all points met all rings
