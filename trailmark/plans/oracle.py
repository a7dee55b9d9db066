"""DuckDB SQL with the same results as ``queries``; columns bear the same names."""

from __future__ import annotations

from ..config import DEFAULTS
from ..functions.keywords import STOP_WORDS
from ..functions.labels import MONTHS, SEASON_OF_MONTH
from ..operators.sequence import resolve_scale
from .catalog import CROWDS, DUCK_CATALOG, DUCK_SNAP_CATALOG, DUCK_SNAP_DISK, POLYGONS

BASE = f"WITH RECURSIVE catalog AS ({DUCK_CATALOG}), base AS (SELECT * FROM catalog WHERE status = 'active' AND ts IS NOT NULL)"
W = "(PARTITION BY project ORDER BY ts, id)"


def hav(a: str, b: str, c: str, d: str) -> str:
    x = (
        f"(sin(radians({c} - ({a})) / 2) * sin(radians({c} - ({a})) / 2)"
        f" + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - ({b})) / 2) * sin(radians({d} - ({b})) / 2))"
    )
    return f"(2 * 6371000.0 * asin(CASE WHEN {x} > 1 THEN 1.0 ELSE sqrt({x}) END))"


def grouped(mode: str, step: int) -> str:
    """CTE ``grouped``: base rows with group_no."""
    s = resolve_scale(step)
    jump = f" OR coalesce({hav('plat', 'plon', 'lat', 'lon')} > CAST({s.meters!r} AS DOUBLE), false)" if mode == "spacetime" else ""
    return f"""{BASE},
prior AS (SELECT *, lag(epoch_us(ts)) OVER {W} AS pt,
  last_value(CASE WHEN lat IS NOT NULL THEN lat END IGNORE NULLS) OVER (PARTITION BY project ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plat,
  last_value(CASE WHEN lat IS NOT NULL THEN lon END IGNORE NULLS) OVER (PARTITION BY project ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS plon FROM base),
grouped AS (SELECT *, sum(CASE WHEN coalesce(epoch_us(ts) - pt > CAST({s.seconds * 1e6!r} AS DOUBLE), false){jump} THEN 1 ELSE 0 END) OVER {W} AS group_no FROM prior)"""


def spans(mode: str, step: int) -> str:
    return grouped(mode, step) + """
SELECT project, CAST(group_no AS BIGINT) AS group_no, min(ts) AS start, max(ts) AS "end", count(*) AS n, count(lat) AS n_geo, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon
FROM grouped GROUP BY project, group_no"""


TRACKS = f"""{BASE},
placed AS (SELECT *, {hav('lag(lat) OVER ' + W, 'lag(lon) OVER ' + W, 'lat', 'lon')} AS leg0, epoch_us(ts) - lag(epoch_us(ts)) OVER {W} AS gap FROM base WHERE lat IS NOT NULL),
flagged AS (SELECT *, coalesce(leg0 > 80000 <GAP>, false) AS brk FROM placed),
numbered AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER {W} AS track_no, CASE WHEN NOT brk THEN leg0 END AS leg_m FROM flagged),
tracks AS (SELECT project, CAST(track_no AS BIGINT) AS track_no, min(ts) AS start, max(ts) AS "end", count(*) AS n, coalesce(sum(leg_m), 0) AS path_m, min(id) AS id, min(country_code) AS country_code FROM numbered GROUP BY project, track_no)
"""
GAP = "OR gap > 8 * 3600000000"

HOME = f"""{BASE},
seen AS (SELECT project, country_code, count(*) AS n, min({{'ts': ts, 'id': id}}) AS seen_at FROM base WHERE country_code <> '' GROUP BY project, country_code),
home AS (SELECT p.project, h.country_code AS home FROM (SELECT DISTINCT project FROM base) p
  LEFT JOIN (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY project ORDER BY n DESC, seen_at) = 1) h ON p.project = h.project),
centre AS (SELECT h.project, any_value(h.home) AS home,
    coalesce(avg(CASE WHEN coalesce(b.country_code, '') = '' OR h.home IS NULL OR b.country_code = h.home THEN b.lat END), avg(b.lat)) AS home_lat,
    coalesce(avg(CASE WHEN coalesce(b.country_code, '') = '' OR h.home IS NULL OR b.country_code = h.home THEN b.lon END), avg(b.lon)) AS home_lon
  FROM home h LEFT JOIN base b ON b.project = h.project AND b.lat IS NOT NULL GROUP BY h.project)"""
RUNS = HOME + f""",
known AS (SELECT b.*, CASE WHEN coalesce(b.country_code, '') <> '' OR b.lat IS NOT NULL THEN
    coalesce(nullif(b.country_code, '') <> c.home, false) OR coalesce({hav('b.lat', 'b.lon', 'c.home_lat', 'c.home_lon')} > 150000, false) END AS k
  FROM base b JOIN centre c ON b.project = c.project),
aways AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY project ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS away FROM known),
cut AS (SELECT *, coalesce(away <> lag(away) OVER {W} OR epoch_us(ts) - lag(epoch_us(ts)) OVER {W} > 3 * 86400000000, false) AS brk FROM aways),
numbered AS (SELECT *, CAST(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER {W} AS BIGINT) AS run_no FROM cut),
runs AS (SELECT *, away AND count(*) OVER r >= 6 AND max(epoch_us(ts)) OVER r - min(epoch_us(ts)) OVER r >= 6 * 3600000000 AS is_trip FROM numbered WINDOW r AS (PARTITION BY project, run_no))"""
COVER = "arg_min(id, {'x': lat IS NULL, 'ts': ts, 'id': id})"
COUNTRIES = "coalesce(string_agg(DISTINCT country_code, ',' ORDER BY country_code), '')"
STAMP = "'%Y-%m-%dT%H:%M:%S.%f'"


def periods(rows: int) -> str:
    return RUNS + f""",
everyday AS (SELECT *, strftime(ts, '%Y-%m') AS month, count(*) OVER (PARTITION BY project, strftime(ts, '%Y-%m')) AS of_month FROM runs WHERE NOT is_trip),
keyed AS (SELECT *, CASE WHEN of_month >= {rows} THEN 'week' ELSE 'month' END AS kind,
  CASE WHEN of_month >= {rows} THEN month || ':' || strftime(date_trunc('week', ts), '%Y-%m-%d') ELSE month END AS key FROM everyday),
periods AS (SELECT project, kind, key, min(ts) AS start, max(ts) AS "end", count(*) AS n, {COVER} AS cover_id, {COUNTRIES} AS countries FROM keyed GROUP BY project, kind, key)"""


TRIPS = f""",
trips AS (SELECT project, run_no, min(ts) AS start, max(ts) AS "end", count(*) AS n, {COVER} AS cover_id, {COUNTRIES} AS countries FROM runs WHERE is_trip GROUP BY project, run_no)"""

#: The fold over each trip's rows, as a recursion over their numbers.
STOPS = RUNS + f""",
ordered AS (SELECT *, row_number() OVER (PARTITION BY project, run_no ORDER BY ts, id) AS rn FROM runs WHERE is_trip),
fold AS (
  SELECT project, run_no, rn, id, ts, CASE WHEN lat IS NULL THEN -1 ELSE 0 END AS stop_no, CASE WHEN lat IS NULL THEN 0 ELSE 1 END AS gps, coalesce(lat, 0.0) AS slat, coalesce(lon, 0.0) AS slon,
         CASE WHEN lat IS NOT NULL THEN ts END AS e, CASE WHEN lat IS NOT NULL THEN country_code END AS country FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.project, o.run_no, o.rn, o.id, o.ts, CASE WHEN opens THEN f.stop_no + 1 ELSE f.stop_no END,
         CASE WHEN opens THEN 1 WHEN o.lat IS NULL THEN f.gps ELSE f.gps + 1 END, CASE WHEN opens THEN o.lat WHEN o.lat IS NULL THEN f.slat ELSE f.slat + o.lat END,
         CASE WHEN opens THEN o.lon WHEN o.lat IS NULL THEN f.slon ELSE f.slon + o.lon END, CASE WHEN o.lat IS NULL THEN f.e ELSE o.ts END,
         CASE WHEN opens THEN o.country_code WHEN o.lat IS NOT NULL AND coalesce(o.country_code, '') <> '' THEN o.country_code ELSE f.country END
  FROM fold f JOIN (SELECT * FROM ordered) o ON o.project = f.project AND o.run_no = f.run_no AND o.rn = f.rn + 1,
       LATERAL (SELECT o.lat IS NOT NULL AND (f.stop_no < 0 OR {hav('o.lat', 'o.lon', 'f.slat / f.gps', 'f.slon / f.gps')} > 25000) AS opens)),
stops AS (SELECT project, run_no, stop_no, round(arg_max(slat / gps, rn), 5) AS lat, round(arg_max(slon / gps, rn), 5) AS lon, max(gps) AS gps, count(*) AS n, min(ts) AS start, max(e) AS "end",
  arg_max({{'c': country}}, rn).c AS country, arg_min(id, rn) AS cover_id FROM fold WHERE stop_no >= 0 GROUP BY project, run_no, stop_no)"""

_stop_list = ", ".join(f"'{w}'" for w in STOP_WORDS)
KEYWORDS = rf"""words AS (
  SELECT project, id, ts, camera_model, country_code, pos, lower(word) AS word FROM (
    SELECT *, unnest(parts) AS word, generate_subscripts(parts, 1) AS pos FROM (SELECT *, string_split_regex(folder_name, '[^A-Za-z]+') AS parts FROM catalog WHERE status = 'active'))
  WHERE length(word) >= 3 AND lower(word) NOT IN ({_stop_list}) AND NOT regexp_matches(lower(word), '^(dcim|img|dsc|pano|mvimg|vid|mov|gopr|p\d+|100\w+|\d+canon|screenshot)$')),
links AS (SELECT project, id, word AS name, min(pos) AS pos FROM words GROUP BY project, id, word)"""

EDGES = f"""edges AS (
  SELECT a.project, a.id AS a, b.id AS b, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS meters FROM base a JOIN base b ON a.project = b.project AND a.id < b.id AND abs(a.lat - b.lat) < 0.003
  WHERE a.lat IS NOT NULL AND b.lat IS NOT NULL AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 300)"""


def closure(edges: str, name: str) -> str:
    """CTE ``name``: (project, id, cluster) of the components of an edge CTE."""
    return f"""both_{name} AS (SELECT project, a, b FROM {edges} UNION ALL SELECT project, b, a FROM {edges}),
reach_{name} AS (SELECT project, a AS id, b AS other FROM both_{name} UNION SELECT r.project, r.id, e.b FROM reach_{name} r JOIN both_{name} e ON r.other = e.a),
{name} AS (SELECT project, id, least(id, min(other)) AS cluster FROM reach_{name} GROUP BY project, id)"""


OVERLAPS = f"""{BASE}, {EDGES}, old_edges AS (SELECT * FROM edges WHERE a % 4 <> 0 AND b % 4 <> 0), {closure('edges', 'fresh')}, {closure('old_edges', 'stale')},
sizes_new AS (SELECT cluster, count(*) AS n FROM fresh GROUP BY 1), sizes_old AS (SELECT cluster, count(*) AS n FROM stale GROUP BY 1),
shared AS (SELECT f.project, f.cluster AS new, s.cluster AS old, count(*) AS shared FROM fresh f JOIN stale s ON f.id = s.id GROUP BY 1, 2, 3),
overlapping AS (SELECT x.*, shared / (a.n + b.n - shared)::DOUBLE AS jaccard FROM shared x JOIN sizes_new a ON x.new = a.cluster JOIN sizes_old b ON x.old = b.cluster)"""

#: Cluster ids after a run: continued ones keep theirs, others count on from the largest of the table.
SNAPSHOT = OVERLAPS + """,
old_table AS (SELECT DISTINCT project, cluster AS cluster_id FROM stale),
sure AS (SELECT new, old FROM overlapping WHERE jaccard > 0.5),
named AS (SELECT n.project, n.cluster, s.old FROM (SELECT DISTINCT project, cluster FROM fresh) n LEFT JOIN sure s ON n.cluster = s.new),
next_ids AS (SELECT project, cluster, coalesce(old, coalesce((SELECT max(cluster_id) + 10000000 FROM old_table t WHERE t.project = n.project), 0) + row_number() OVER (PARTITION BY project, old IS NULL ORDER BY cluster)) AS cluster_id,
  coalesce(old % 3 = 0, false) AS custom_named FROM named n)"""

SNAPS = f"WITH cat AS ({DUCK_SNAP_CATALOG}), disk AS ({DUCK_SNAP_DISK})"
ACTIONS = f"""{SNAPS}, actions AS (
  SELECT coalesce(c.path, d.path) AS path, c.id, c.status AS old_status, d.size, d.mtime, d.content_hash,
         CASE WHEN d.path IS NULL THEN CASE WHEN c.status = 'missing' THEN 'gone' ELSE 'missing' END WHEN c.path IS NULL THEN 'new'
              WHEN c.size <> d.size OR c.mtime <> d.mtime THEN 'update' WHEN c.status = 'missing' THEN 'reactivate' ELSE 'skip' END AS action
  FROM cat c FULL JOIN disk d ON c.path = d.path),
gone AS (SELECT c.*, row_number() OVER (PARTITION BY c.content_hash ORDER BY c.id) AS k FROM cat c JOIN actions a ON a.id = c.id WHERE a.action IN ('missing', 'gone')),
fresh AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY path) AS k FROM actions WHERE action = 'new'),
moves AS (SELECT g.id, g.path AS old_path, f.path AS new_path, f.size, f.mtime, f.content_hash FROM fresh f JOIN gone g ON f.content_hash = g.content_hash AND f.k = g.k)"""


def ring_test(rings: list) -> str:
    """Even-odd rule over literal rings, as the number of crossed edges."""
    tests = []
    for ring in rings:
        parts = [f"(CASE WHEN ({y1} > lat) <> ({y0} > lat) AND lon < ({x0} - ({x1}))::DOUBLE * (lat - ({y1})) / nullif({y0} - ({y1}), 0) + {x1} THEN 1 ELSE 0 END)" for (x1, y1), (x0, y0) in zip(ring, [ring[-1], *ring[:-1]], strict=True)]
        tests.append(f"({' + '.join(parts)}) % 2 = 1")
    return "(" + " OR ".join(tests) + ")"


GEOCODE = f"{BASE} SELECT id, CASE " + " ".join(f"WHEN {ring_test(rings)} THEN '{iso}'" for _, iso, rings in POLYGONS) + " END AS iso FROM base WHERE lat IS NOT NULL"


def rollup(kind: str) -> str:
    key = {"decade": "CAST(year(ts) // 10 * 10 AS VARCHAR) || 's'", "year": "strftime(ts, '%Y')", "month": "strftime(ts, '%Y-%m')"}[kind]
    return f"""{BASE}, keyed AS (SELECT *, {key} AS period_key FROM base),
cameras AS (SELECT project, period_key, camera_model, count(*) AS n FROM keyed WHERE camera_model <> '' GROUP BY 1, 2, 3),
named AS (SELECT project, period_key, '{{' || string_agg('"' || camera_model || '":' || n, ',' ORDER BY n DESC, camera_model) || '}}' AS j FROM cameras GROUP BY 1, 2)
SELECT k.project, '{kind}' AS period_type, k.period_key, count(*) AS photo_count,
       '[' || coalesce(string_agg(DISTINCT '"' || country_code || '"', ',' ORDER BY '"' || country_code || '"'), '') || ']' AS countries_list, any_value(coalesce(j, '{{}}')) AS camera_models_counts
FROM keyed k LEFT JOIN named m ON k.project = m.project AND k.period_key = m.period_key GROUP BY k.project, k.period_key"""


def pick(names: tuple[str, ...], c: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][month({c})]"


def date_label(a: str, b: str) -> str:
    y1, y2, s1, s2 = f"year({a})", f"year({b})", pick(SEASON_OF_MONTH, a), pick(SEASON_OF_MONTH, b)
    m1, m2 = pick(MONTHS, a), pick(MONTHS, b)
    return f"""CASE WHEN CAST({a} AS DATE) = CAST({b} AS DATE) THEN {m1} || ' ' || day({a}) || ', ' || {y1}
  WHEN {y1} = {y2} AND month({a}) = month({b}) THEN {m1} || ' ' || day({a}) || '–' || day({b}) || ', ' || {y1}
  WHEN {y1} = {y2} AND month({a}) = 1 AND month({b}) = 12 AND (epoch_us({b}) - epoch_us({a})) / 86400000000.0 > 300 THEN CAST({y1} AS VARCHAR)
  WHEN {y1} = {y2} AND {s1} = {s2} THEN {s1} || ' ' || {y1} WHEN {y1} = {y2} THEN {m1} || ' – ' || {m2} || ' ' || {y1}
  WHEN (epoch_us({b}) - epoch_us({a})) / 86400000000.0 > 330 * ({y2} - {y1}) THEN {y1} || '–' || {y2} ELSE {m1} || ' ' || {y1} || ' – ' || {m2} || ' ' || {y2} END"""


PLACES = f""", {KEYWORDS},
cc AS (SELECT project, group_no, country_code AS country FROM (SELECT project, group_no, country_code, count(*) AS n, min({{'ts': ts, 'id': id}}) AS seen_at FROM grouped WHERE country_code <> '' GROUP BY 1, 2, 3)
  QUALIFY row_number() OVER (PARTITION BY project, group_no ORDER BY n DESC, seen_at) = 1),
kw AS (SELECT g.project, g.group_no, l.name, count(*) AS n, min({{'ts': g.ts, 'id': g.id, 'pos': l.pos}}) AS seen_at FROM grouped g JOIN links l ON g.id = l.id GROUP BY 1, 2, 3),
best AS (SELECT k.* FROM kw k LEFT JOIN cc ON k.project = cc.project AND k.group_no = cc.group_no WHERE country IS NULL OR name <> lower(country)
  QUALIFY row_number() OVER (PARTITION BY k.project, k.group_no ORDER BY n DESC, seen_at) = 1),
places AS (SELECT DISTINCT g.project, CAST(g.group_no AS BIGINT) AS group_no,
  coalesce(CASE WHEN country IS NULL THEN upper(name[1]) || name[2:] ELSE upper(name[1]) || name[2:] || ', ' || country END, country, 'Area') AS place
  FROM grouped g LEFT JOIN cc ON g.project = cc.project AND g.group_no = cc.group_no LEFT JOIN best b ON g.project = b.project AND g.group_no = b.group_no)"""

PATHS = """, legs AS (SELECT project, group_no, """ + hav(*(f"lag({c}) OVER (PARTITION BY project, group_no ORDER BY ts, id)" for c in ("lat", "lon")), "lat", "lon") + """ AS leg FROM grouped WHERE lat IS NOT NULL),
paths AS (SELECT project, CAST(group_no AS BIGINT) AS group_no, coalesce(sum(leg), 0) AS path_m FROM legs GROUP BY project, group_no)"""

SHOWN = """, ranked AS (SELECT project, CAST(group_no AS BIGINT) AS group_no, id, ts, row_number() OVER (PARTITION BY project, group_no ORDER BY ts, id) - 1 AS pos, count(*) OVER (PARTITION BY project, group_no) AS n FROM grouped),
shown AS (SELECT project, group_no, id, ts FROM ranked WHERE n <= 5 OR pos IN (0, floor((n - 1) / 4.0 + 0.5), floor(2 * (n - 1) / 4.0 + 0.5), floor(3 * (n - 1) / 4.0 + 0.5), n - 1))"""

_st8 = grouped("spacetime", 8)
_tag_rows = f"{BASE}, {KEYWORDS}"

SQL: dict[str, str] = {
    "groups_spacetime_trip": spans("spacetime", 8),
    "groups_two_level": spans("spacetime", 8),
    "groups_time_event": spans("time", 0),
    "zoom_group_counts": f"""{BASE},
prior AS (SELECT *, lag(epoch_us(ts)) OVER {W} AS pt, last_value(lat IGNORE NULLS) OVER p AS plat, last_value(lon IGNORE NULLS) OVER p AS plon FROM base
  WINDOW p AS (PARTITION BY project ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
gaps AS (SELECT project, (epoch_us(ts) - pt) / CAST(1e6 AS DOUBLE) AS gap, {hav('plat', 'plon', 'lat', 'lon')} AS jump FROM prior),
scales(step, tier, s, m) AS (VALUES {', '.join(f"({i}, '{x.tier}', CAST({x.seconds!r} AS DOUBLE), CAST({x.meters!r} AS DOUBLE))" for i, x in ((i, resolve_scale(i)) for i in range(DEFAULTS.steps + 1)))})
SELECT project, step, tier, CAST(1 + sum(CASE WHEN coalesce(gap > s, false) OR coalesce(jump > m, false) THEN 1 ELSE 0 END) AS BIGINT) AS n_groups FROM gaps, scales GROUP BY project, step, tier""",
    "group_cards": _st8 + PLACES + PATHS + SHOWN + f""",
firsts AS (SELECT project, group_no, country_code, min({{'ts': ts, 'id': id}}) AS seen_at FROM grouped WHERE country_code <> '' GROUP BY 1, 2, 3),
orders AS (SELECT project, group_no, string_agg(country_code, ',' ORDER BY seen_at) AS countries FROM firsts GROUP BY 1, 2),
cards AS (SELECT project, CAST(group_no AS BIGINT) AS group_no, min(ts) AS start, max(ts) AS "end", count(*) AS n, count(lat) AS n_geo, {COVER} AS cover_id, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon,
  round(min(lat), 5) AS min_lat, round(max(lon), 5) AS max_lon FROM grouped GROUP BY project, group_no),
labeled AS (SELECT c.*, CAST(floor(coalesce(path_m, 0) / 1000 + 0.5) AS BIGINT) AS km, coalesce(countries, '') AS countries, place, {date_label('start', '"end"')} AS date_label, n_geo > 0 AS is_geo
  FROM cards c LEFT JOIN paths p ON c.project = p.project AND c.group_no = p.group_no LEFT JOIN orders o ON c.project = o.project AND c.group_no = o.group_no
  JOIN places l ON c.project = l.project AND c.group_no = l.group_no)
SELECT l.*, CASE WHEN is_geo THEN place ELSE date_label END AS title, s.preview_ids FROM labeled l
JOIN (SELECT project, group_no, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ts, id) AS preview_ids FROM shown GROUP BY 1, 2) s ON l.project = s.project AND l.group_no = s.group_no""",
    "group_members": _st8 + " SELECT project, CAST(group_no AS BIGINT) AS group_no, id FROM grouped",
    "group_path_m": _st8 + PATHS + " SELECT project, group_no, round(path_m, 3) AS path_m FROM paths",
    "preview_ids": _st8 + SHOWN + " SELECT project, group_no, id FROM shown",
    "timeline_page1": f"{BASE} SELECT id, ts, file_name, folder_name, country_code, camera_model FROM base ORDER BY ts DESC, id DESC LIMIT 120",
    "timeline_page2": f"{BASE} SELECT id, ts, file_name FROM base ORDER BY ts DESC, id DESC LIMIT 120 OFFSET 120",
    "geo_listing": f"{BASE} SELECT id, file_name, folder_name, ts, round(lat, 5) AS lat, round(lon, 5) AS lon, country_code FROM base WHERE lat IS NOT NULL",
    "catalog_totals": f"{BASE} SELECT project, count(*) AS n, count(lat) AS n_geo, min(ts) AS first_ts, max(ts) AS last_ts, CAST(0 AS BIGINT) AS n_missing FROM base GROUP BY project",
    "catalog_fingerprint": f"{BASE} SELECT project, count(*) AS n, max(id) AS max_id, max(epoch_us(ts)) AS max_change FROM catalog GROUP BY project",
    "facet_country": f"{BASE} SELECT country_code AS value, count(*) AS n FROM catalog WHERE status = 'active' AND country_code IS NOT NULL GROUP BY 1",
    "facet_camera": f"{BASE} SELECT camera_model AS value, count(*) AS n FROM catalog WHERE status = 'active' AND camera_model IS NOT NULL GROUP BY 1",
    "facet_year": f"{BASE} SELECT strftime(ts, '%Y') AS value, count(*) AS n FROM catalog WHERE status = 'active' AND ts IS NOT NULL GROUP BY 1",
    "calendar_years": f"{BASE} SELECT strftime(ts, '%Y') AS key, count(*) AS n FROM base GROUP BY 1",
    "calendar_months": f"{BASE} SELECT strftime(ts, '%Y-%m') AS key, count(*) AS n FROM base WHERE year(ts) = 2024 GROUP BY 1",
    "calendar_days": f"{BASE} SELECT strftime(ts, '%Y-%m-%d') AS key, count(*) AS n FROM base WHERE strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1",
    "calendar_levels": f"""{BASE} SELECT 'year' AS level, strftime(ts, '%Y') AS key, count(*) AS n FROM base GROUP BY 2 UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM base GROUP BY 2
UNION ALL SELECT 'day', strftime(ts, '%Y-%m-%d'), count(*) FROM base GROUP BY 2""",
    **{f"rollups_{k}": rollup(k) for k in ("decade", "year", "month")},
    "day_groups": f"{BASE} SELECT project, CAST(ts AS DATE) AS day, count(*) AS n, {COUNTRIES} AS countries FROM base GROUP BY 1, 2",
    "filter_search": f"{BASE} SELECT id FROM base WHERE lower(file_name) LIKE '%red%weekend%' OR lower(folder_name) LIKE '%red%weekend%'",
    "filter_month_country_camera": f"{BASE} SELECT id FROM base WHERE strftime(ts, '%Y-%m') = '2024-01' AND country_code = 'NATION_3' AND camera_model = 'click'",
    "filter_day": f"{BASE} SELECT id FROM base WHERE CAST(ts AS DATE) = DATE '2024-01-15'",
    "tag_filter_any": f"{_tag_rows} SELECT id FROM base WHERE id IN (SELECT id FROM links WHERE name = 'vacation')",
    "tag_filter_all": f"{_tag_rows} SELECT id FROM base WHERE id IN (SELECT id FROM links WHERE name = 'vacation') AND id IN (SELECT id FROM links WHERE name = 'red')",
    "journey_tracks": TRACKS.replace("<GAP>", GAP) + 'SELECT project, track_no, start, "end", n, round(path_m, 3) AS path_m FROM tracks WHERE n >= 2',
    "journey_singles": TRACKS.replace("<GAP>", GAP) + "SELECT project, id, start AS ts, country_code FROM tracks WHERE n = 1",
    "journey_stats": TRACKS.replace("<GAP>", GAP) + """SELECT project, CAST(sum(n) AS BIGINT) AS photos, count(CASE WHEN n >= 2 THEN 1 END) AS tracks, count(CASE WHEN n = 1 THEN 1 END) AS standalone,
CAST(floor(coalesce(sum(CASE WHEN n >= 2 THEN path_m END), 0) / 1000 + 0.5) AS BIGINT) AS total_km FROM tracks GROUP BY project""",
    "track_distance_only": TRACKS.replace("<GAP>", "") + "SELECT project, track_no, n, round(path_m, 3) AS path_m FROM tracks WHERE n >= 2",
    "track_projection": f"""{BASE}, placed AS (SELECT *, row_number() OVER {W} AS rank FROM base WHERE lat IS NOT NULL QUALIFY rank <= 80),
box0 AS (SELECT project, min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM placed GROUP BY project),
box AS (SELECT project, CASE WHEN b - a < 1e-4 THEN a - 0.05 ELSE a END AS a, CASE WHEN b - a < 1e-4 THEN b + 0.05 ELSE b END AS b, CASE WHEN d - c < 1e-4 THEN c - 0.05 ELSE c END AS c, CASE WHEN d - c < 1e-4 THEN d + 0.05 ELSE d END AS d FROM box0),
scaled AS (SELECT *, least(880.0::DOUBLE / (d - c), 460.0::DOUBLE / (b - a)) AS s FROM box)
SELECT p.project, id, rank, round((960 - (d - c) * s) / 2 + (lon - c) * s, 3) AS x, round(540 - ((540 - (b - a) * s) / 2 + (lat - a) * s), 3) AS y FROM placed p JOIN scaled q ON p.project = q.project""",
    "home_country": HOME + " SELECT * FROM home",
    "home_centroid": HOME + " SELECT project, home, round(home_lat, 5) AS home_lat, round(home_lon, 5) AS home_lon FROM centre",
    "away_runs": RUNS + ' SELECT project, run_no, away, is_trip, count(*) AS n, min(ts) AS start, max(ts) AS "end" FROM runs GROUP BY 1, 2, 3, 4',
    "trips": RUNS + TRIPS + " SELECT * FROM trips",
    "periods": periods(30) + " SELECT * FROM periods",
    "periods_sparse": periods(50) + " SELECT project, kind, key, n FROM periods",
    "moments_list": periods(30) + TRIPS + f"""
SELECT project, 'trip:' || strftime(start, {STAMP}) || ':' || strftime("end", {STAMP}) AS moment_id, 'trip' AS kind, start, "end", n, cover_id FROM trips
UNION ALL SELECT project, 'period:' || kind || ':' || key, kind, start, "end", n, cover_id FROM periods""",
    "trip_stops": STOPS + " SELECT * FROM stops",
    "stop_assignment": STOPS + """, placed AS (SELECT o.project, o.run_no, o.id, coalesce((SELECT min(s.stop_no) FROM stops s WHERE s.project = o.project AND s.run_no = o.run_no AND s."end" >= o.ts),
  (SELECT max(s.stop_no) FROM stops s WHERE s.project = o.project AND s.run_no = o.run_no)) AS stop_no FROM ordered o)
SELECT project, run_no, stop_no, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM placed WHERE stop_no IS NOT NULL GROUP BY 1, 2, 3""",
    "folder_keyword_counts": f"{_tag_rows} SELECT name, count(*) AS n, count(DISTINCT project) AS projects FROM links GROUP BY name",
    "itemsets": f"""{_tag_rows}, total AS (SELECT count(*) AS total, greatest(2, CAST(ceil(0.05 * count(*)) AS BIGINT)) AS least_n FROM base), own AS (SELECT l.* FROM links l JOIN base b ON l.id = b.id),
sets AS (SELECT a.name || '+' || b.name AS items, 2 AS size, count(*) AS n FROM own a JOIN own b ON a.id = b.id AND a.name < b.name GROUP BY 1
  UNION ALL SELECT a.name || '+' || b.name || '+' || c.name, 3, count(*) FROM own a JOIN own b ON a.id = b.id AND a.name < b.name JOIN own c ON b.id = c.id AND b.name < c.name GROUP BY 1)
SELECT items, size, n, total FROM sets, total WHERE n >= least_n ORDER BY n DESC, size, items LIMIT 40""",
    "tag_reconcile": f"""{_tag_rows},
old AS (SELECT project, id, arg_min(name, pos) AS name, 'automatic' AS type FROM links GROUP BY project, id UNION ALL SELECT project, id, camera_model, 'automatic' FROM catalog
  UNION ALL SELECT project, id, 'city', 'manual' FROM catalog WHERE id % 3 = 0),
types AS (SELECT project, name, min(type) AS type FROM old GROUP BY project, name),
kept AS (SELECT * FROM old WHERE type = 'manual' UNION ALL SELECT o.* FROM old o SEMI JOIN links l ON o.id = l.id AND o.name = l.name WHERE o.type = 'automatic'),
added AS (SELECT l.project, l.id, l.name, coalesce(t.type, 'automatic') AS type FROM links l ANTI JOIN old o ON l.id = o.id AND l.name = o.name LEFT JOIN types t ON l.project = t.project AND l.name = t.name)
SELECT project, name, type, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT project, id, name, type FROM kept UNION ALL SELECT * FROM added) GROUP BY 1, 2, 3""",
    "recommend_top12": f"""{_tag_rows},
near AS (SELECT a.id, b.id AS other FROM base a JOIN base b ON a.project = b.project AND a.id <> b.id AND abs(a.lat - b.lat) < 0.002 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 200),
soon AS (SELECT a.id, b.id AS other FROM base a JOIN base b ON a.project = b.project AND a.id <> b.id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 12 * 3600000000),
ns AS (SELECT id, count(*) AS n FROM near GROUP BY 1), nt AS (SELECT id, count(*) AS n FROM soon GROUP BY 1),
ks AS (SELECT x.id, name, count(*) AS k FROM near x JOIN links l ON x.other = l.id GROUP BY 1, 2), kt AS (SELECT x.id, name, count(*) AS k FROM soon x JOIN links l ON x.other = l.id GROUP BY 1, 2),
kf AS (SELECT DISTINCT a.id, l.name FROM base a JOIN base b ON a.project = b.project AND a.folder_name = b.folder_name JOIN links l ON b.id = l.id),
cand AS (SELECT id, name FROM ks UNION SELECT id, name FROM kt UNION SELECT id, name FROM kf),
parts AS (SELECT c.id, c.name, coalesce(ks.k, 0) AS k_spatial, coalesce(ns.n, 0) AS n_spatial, coalesce(kt.k, 0) AS k_temporal, coalesce(nt.n, 0) AS n_temporal, CASE WHEN kf.id IS NULL THEN 0 ELSE 1 END AS k_folder
  FROM cand c ANTI JOIN links l ON c.id = l.id AND c.name = l.name LEFT JOIN ks ON c.id = ks.id AND c.name = ks.name LEFT JOIN kt ON c.id = kt.id AND c.name = kt.name
  LEFT JOIN kf ON c.id = kf.id AND c.name = kf.name LEFT JOIN ns ON c.id = ns.id LEFT JOIN nt ON c.id = nt.id),
scored AS (SELECT *, round(0.5::DOUBLE * CASE WHEN n_spatial > 0 THEN k_spatial / n_spatial::DOUBLE ELSE 0 END + 0.3::DOUBLE * CASE WHEN n_temporal > 0 THEN k_temporal / n_temporal::DOUBLE ELSE 0 END + 0.2::DOUBLE * k_folder, 9) AS score FROM parts)
SELECT b.project, s.id, name, score, k_spatial, n_spatial, k_temporal, n_temporal, CAST(k_folder AS BIGINT) AS k_folder, row_number() OVER (PARTITION BY s.id ORDER BY score DESC, name) AS rank
FROM scored s JOIN base b ON s.id = b.id WHERE score > 0.15 QUALIFY rank <= 12""",
    "neighbour_pairs_300m": f"{BASE}, {EDGES} SELECT project, a, b, round(meters, 3) AS meters FROM edges",
    "temporal_pairs_12h": f"{BASE} SELECT a.project, a.id AS l_id, count(*) AS n FROM base a JOIN base b ON a.project = b.project AND a.id <> b.id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 12 * 3600000000 GROUP BY 1, 2",
    "distance_to_home": HOME + f" SELECT b.id, round({hav('b.lat', 'b.lon', 'c.home_lat', 'c.home_lon')}, 3) AS meters FROM base b JOIN centre c ON b.project = c.project WHERE b.lat IS NOT NULL",
    "clusters_300m": f"{BASE}, {EDGES}, {closure('edges', 'found')} SELECT * FROM found",
    "clusters_300m_min4": f"""{BASE}, {EDGES}, ends AS (SELECT project, a, b FROM edges UNION ALL SELECT project, b, a FROM edges), core AS (SELECT a AS id FROM ends GROUP BY a HAVING count(*) + 1 >= 4),
inner_edges AS (SELECT e.project, e.a, e.b FROM ends e JOIN core x ON e.a = x.id JOIN core y ON e.b = y.id), {closure('inner_edges', 'linked')},
cores AS (SELECT b.project, b.id, coalesce(l.cluster, b.id) AS cluster FROM base b JOIN core c ON b.id = c.id LEFT JOIN linked l ON b.id = l.id)
SELECT * FROM cores UNION ALL SELECT e.project, e.a, min(c.cluster) FROM ends e JOIN cores c ON e.b = c.id ANTI JOIN core x ON e.a = x.id GROUP BY 1, 2""",
    "cluster_summary": f"""{BASE}, {EDGES}, {closure('edges', 'found')}, ranked AS (SELECT f.project, f.cluster, b.id, b.lat, b.lon, b.country_code, row_number() OVER (PARTITION BY f.cluster ORDER BY b.id) AS r FROM found f JOIN base b ON f.id = b.id)
SELECT project, cluster, count(*) AS n, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon, {COUNTRIES} AS countries, string_agg(CASE WHEN r <= 4 THEN CAST(id AS VARCHAR) END, ',' ORDER BY id) AS sample_ids FROM ranked GROUP BY 1, 2""",
    "cluster_match": OVERLAPS + " SELECT project, new, old, shared, round(jaccard, 9) AS jaccard FROM overlapping WHERE jaccard > 0.5",
    "geocode": f"SELECT * FROM ({GEOCODE}) WHERE iso IS NOT NULL",
    "snapshot_actions": ACTIONS + " SELECT path, id, action FROM actions",
    "move_matches": ACTIONS + " SELECT id, old_path, new_path FROM moves",
    "next_catalog": ACTIONS + """,
kept AS (SELECT c.id, c.path, CASE WHEN a.action = 'update' THEN a.size ELSE c.size END AS size, CASE WHEN a.action = 'update' THEN a.mtime ELSE c.mtime END AS mtime,
  CASE WHEN a.action = 'update' THEN a.content_hash ELSE c.content_hash END AS content_hash, CASE a.action WHEN 'missing' THEN 'missing' WHEN 'reactivate' THEN 'active' WHEN 'update' THEN 'active' ELSE c.status END AS status
  FROM cat c JOIN actions a ON c.id = a.id ANTI JOIN moves m ON c.id = m.id)
SELECT * FROM kept UNION ALL SELECT id, new_path, size, mtime, content_hash, 'active' FROM moves
UNION ALL SELECT (SELECT max(id) FROM cat) + row_number() OVER (ORDER BY f.path), f.path, f.size, f.mtime, f.content_hash, 'active' FROM fresh f ANTI JOIN moves m ON f.path = m.new_path""",
    "scan_summary": ACTIONS + """, tally AS (SELECT action, count(*) AS n FROM actions WHERE action <> 'gone' GROUP BY action)
SELECT action, n FROM (SELECT action, CASE WHEN action = 'new' THEN n - (SELECT count(*) FROM moves) ELSE n END AS n FROM tally) WHERE n > 0 UNION ALL SELECT 'moved', count(*) FROM moves""",
    "duplicates": SNAPS + " SELECT content_hash, count(*) AS n, min(id) AS first_id FROM cat GROUP BY content_hash HAVING count(*) > 1",
    "retention": """SELECT doc_id AS id, sum(n_chars) OVER (ORDER BY (doc_id * 7919) % 100003 DESC, doc_id DESC) <= (SELECT sum(n_chars) // 2 FROM documents) AS keep FROM documents""",
    "utc_normalize": f"""{BASE}, timed AS (SELECT id, date_trunc('second', ts) AS wall, coalesce(CASE camera_model WHEN 'click' THEN 120 WHEN 'view' THEN -450 WHEN 'purchase' THEN 0 END, CAST(floor(lon / 15 + 0.5) * 60 AS INT), 0) AS m FROM catalog)
SELECT id, wall - to_minutes(m) AS utc, CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0') AS tz_offset FROM timed""",
    "offset_parse": f"{BASE} SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE CAST(id % 1600 - 800 AS INT) END AS minutes FROM catalog",
    "group_labels": grouped("time", 24) + f""", spans AS (SELECT project, CAST(group_no AS BIGINT) AS group_no, min(ts) AS a, max(ts) AS b FROM grouped GROUP BY 1, 2) SELECT project, group_no, {date_label('a', 'b')} AS label FROM spans""",
    "place_name": _st8 + PLACES + " SELECT project, group_no, place FROM places",
    "file_kinds": f"""{BASE}, made AS (SELECT [ 'jpg', 'png', 'webp', 'heic', 'txt', NULL ][CAST(id % 6 + 1 AS INT)] AS format FROM catalog)
SELECT format, coalesce(format IN ('jpg', 'jpeg', 'png', 'webp'), false) AS writable, coalesce(format IN ('jpg', 'jpeg'), false) AS write_back, count(*) AS n FROM made GROUP BY 1""",
    "photo_tag_names": f"{_tag_rows} SELECT project, id, string_agg(name, ',' ORDER BY name) AS names, count(CASE WHEN name = 'summer' THEN 1 END) AS by_hand FROM links GROUP BY 1, 2",
    "orphan_tags": f"{_tag_rows} SELECT DISTINCT c.project, c.camera_model AS name FROM catalog c WHERE c.camera_model IS NOT NULL AND NOT EXISTS (SELECT 1 FROM links l WHERE l.project = c.project AND l.name = c.camera_model)",
    "tag_edits": f"""{_tag_rows},
rest AS (SELECT project, id, name, 'automatic' AS type FROM links WHERE NOT (name = 'vacation' AND id % 5 = 0)),
added AS (SELECT project, id, 'favourite' AS name FROM catalog WHERE id % 3 = 0 UNION ALL SELECT project, id, 'city' FROM catalog WHERE id % 7 = 0),
fresh AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM links l WHERE l.project = a.project AND l.name = a.name) THEN 'automatic' ELSE 'manual' END AS type
  FROM added a ANTI JOIN rest r ON a.id = r.id AND a.name = r.name)
SELECT project, name, type, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT * FROM rest UNION ALL SELECT * FROM fresh) GROUP BY 1, 2, 3""",
    "catalog_fingerprint_links": f"""{_tag_rows}, {EDGES}, {closure('edges', 'found')}
SELECT c.project, count(*) AS n, max(id) AS max_id, max(epoch_us(ts)) AS max_change, (SELECT count(*) FROM links l WHERE l.project = c.project) AS n_tag_links,
  (SELECT count(*) FROM found f WHERE f.project = c.project) AS n_cluster_links FROM catalog c GROUP BY c.project""",
    "filter_cluster": f"{BASE}, {EDGES}, {closure('edges', 'found')} SELECT id FROM found WHERE cluster = (SELECT min(cluster) FROM found)",
    "neighbour_pairs_clamped": f"{BASE}, {EDGES} SELECT project, a, b FROM edges WHERE meters <= 50",
    "cluster_snapshot": SNAPSHOT + """
SELECT project, cluster_id, CASE WHEN custom_named THEN 'Place ' || cluster_id END AS given_name, CAST(300 AS DOUBLE) AS radius_meters, custom_named FROM next_ids
UNION ALL SELECT project, cluster_id + 10000000, 'Place ' || cluster_id, CAST(500 AS DOUBLE), cluster_id % 3 = 0 FROM old_table""",
    "cluster_links": SNAPSHOT + """
SELECT f.project, f.id, n.cluster_id FROM fresh f JOIN next_ids n ON f.cluster = n.cluster UNION ALL SELECT project, id, cluster + 10000000 FROM stale""",
    "cluster_renames": SNAPSHOT + """, both_radii AS (SELECT project, cluster_id, cluster_id AS shown, cluster_id % 3 = 0 AS by_hand FROM old_table UNION ALL SELECT project, cluster_id + 10000000, cluster_id, cluster_id % 3 = 0 FROM old_table)
SELECT project, cluster_id, CASE WHEN cluster_id % 2 = 0 THEN 'My ' || cluster_id ELSE 'Place ' || shown END AS name, by_hand OR cluster_id % 2 = 0 AS custom_named FROM both_radii""",
    "cluster_identities": OVERLAPS + f""",
sure AS (SELECT project, new, old, jaccard FROM overlapping WHERE jaccard > 0.5),
centres_new AS (SELECT f.cluster AS new, avg(b.lat) AS la, avg(b.lon) AS lo FROM fresh f JOIN base b ON f.id = b.id GROUP BY 1),
centres_old AS (SELECT f.cluster AS old, avg(b.lat) AS la, avg(b.lon) AS lo FROM stale f JOIN base b ON f.id = b.id GROUP BY 1),
rivals AS (SELECT o.project, o.new, o.old, o.jaccard, row_number() OVER (ORDER BY o.jaccard DESC, o.new, o.old) AS k FROM overlapping o JOIN centres_new n ON o.new = n.new JOIN centres_old c ON o.old = c.old
  ANTI JOIN sure s ON o.new = s.new ANTI JOIN sure t ON o.old = t.old WHERE {hav('n.la', 'n.lo', 'c.la', 'c.lo')} < 100),
greedy AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS news, CAST([] AS BIGINT[]) AS olds, CAST([] AS BIGINT[]) AS picked
  UNION ALL SELECT r.k, CASE WHEN ok THEN list_append(g.news, r.new) ELSE g.news END, CASE WHEN ok THEN list_append(g.olds, r.old) ELSE g.olds END, CASE WHEN ok THEN list_append(g.picked, r.k) ELSE g.picked END
  FROM greedy g JOIN rivals r ON r.k = g.k + 1, LATERAL (SELECT NOT list_contains(g.news, r.new) AND NOT list_contains(g.olds, r.old) AS ok)),
chosen AS (SELECT unnest(picked) AS k FROM (SELECT arg_max(picked, k) AS picked FROM greedy))
SELECT project, new, old, round(jaccard, 9) AS jaccard, 'overlap' AS rule FROM sure UNION ALL SELECT project, new, old, round(jaccard, 9), 'centre' FROM rivals JOIN chosen USING (k)""",
    "number_texts": f"{BASE} SELECT id, CAST(CASE id % 7 WHEN 0 THEN id WHEN 1 THEN -(id + 0.5) WHEN 2 THEN CAST('0.' || id AS DOUBLE) WHEN 3 THEN id * 100 WHEN 6 THEN id END AS DOUBLE) AS number FROM catalog",
    "wall_times": f"{BASE} SELECT id, CASE WHEN id % 5 IN (0, 1, 4) THEN date_trunc('second', ts) END AS wall FROM catalog",
    "country_labels": f"""{BASE} SELECT CASE id % 5 WHEN 0 THEN 'United States' WHEN 2 THEN 'DR Congo' WHEN 3 THEN 'South Korea' ELSE CASE WHEN id % 2 = 0 THEN 'Data name' WHEN id % 5 = 1 THEN 'FR' ELSE 'DE' END END AS label,
  count(*) AS n FROM catalog GROUP BY 1""",
}
SQL |= {"zoom_two_level": SQL["zoom_group_counts"], "tracks_two_level": SQL["journey_tracks"], "runs_two_level": SQL["away_runs"]}
_whole = f"{BASE}, each_period AS (SELECT *, unnest(['decade', 'year', 'month']) AS period_type, unnest([CAST(year(ts) // 10 * 10 AS VARCHAR) || 's', strftime(ts, '%Y'), strftime(ts, '%Y-%m')]) AS period_key FROM base)"
SQL |= {
    "stream_sessions_2h": f"""{BASE}, cut AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER {W} > 7200000000, false) AS brk FROM base),
numbered AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER {W} AS s FROM cut)
SELECT project, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM numbered GROUP BY project, s
HAVING max(epoch_us(ts)) + 7200000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 86400000000 FROM base)""",
    "ingest_streamed": SQL["next_catalog"],
    "rollups_touched": f"""{_whole}, touched AS (SELECT DISTINCT project, period_type, period_key FROM each_period WHERE project < 10 AND camera_model = 'error')
SELECT project, period_type, period_key, count(*) AS photo_count FROM each_period SEMI JOIN touched USING (project, period_type, period_key) GROUP BY 1, 2, 3""",
    "rollups_stored": SQL["rollups_month"],
    "catalog_stored": f"{BASE} SELECT project, id, file_name, ts, camera_model, CAST(NULL AS INT) AS orientation FROM catalog",
    "geocode_built": SQL["geocode"],
    "filters_off": f"{BASE} SELECT id FROM base",
}

_crowds = f"""{BASE}, crowd AS ({CROWDS.replace('<BASE>', 'base')}), pairs AS (
  SELECT a.project, a.id AS a, b.id AS b, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS meters FROM crowd a JOIN crowd b ON a.project = b.project AND abs(a.lat - b.lat) < 0.001 AND abs(a.lon - b.lon) < 0.001)"""
_followed = f"""{BASE}, after AS (
  SELECT project, id, ts, CASE WHEN id % 10 = 3 THEN 'NATION_0' ELSE country_code END AS country_code, CASE WHEN id % 10 = 3 THEN 'moved' ELSE camera_model END AS camera_model FROM base WHERE id % 10 <> 5),
each_period AS (SELECT *, unnest(['decade', 'year', 'month']) AS period_type, unnest([CAST(year(ts) // 10 * 10 AS VARCHAR) || 's', strftime(ts, '%Y'), strftime(ts, '%Y-%m')]) AS period_key FROM after),
cams AS (SELECT project, period_type, period_key, camera_model, count(*) AS n FROM each_period WHERE camera_model IS NOT NULL GROUP BY ALL),
dict AS (SELECT project, period_type, period_key, '{{' || string_agg('"' || camera_model || '":' || n, ',' ORDER BY n DESC, camera_model) || '}}' AS camera_models_counts FROM cams GROUP BY ALL),
lands AS (SELECT project, period_type, period_key, count(*) AS photo_count, list_sort(list(DISTINCT country_code) FILTER (country_code IS NOT NULL)) AS c FROM each_period GROUP BY ALL)
SELECT project, period_type, period_key, photo_count, coalesce('[' || list_aggregate(list_transform(c, lambda x: '"' || x || '"'), 'string_agg', ',') || ']', '[]') AS countries_list, coalesce(camera_models_counts, '{{}}') AS camera_models_counts
FROM lands LEFT JOIN dict USING (project, period_type, period_key)"""
SQL |= {
    "crowd_clusters": f"{_crowds}, near AS (SELECT project, a, b FROM pairs WHERE a < b AND meters <= 40), {closure('near', 'found')} SELECT * FROM found",
    "crowd_clusters_min6": f"""{_crowds}, ends AS (SELECT project, a, b FROM pairs WHERE a <> b AND meters <= 25), core AS (SELECT a AS id FROM ends GROUP BY a HAVING count(*) + 1 >= 6),
inner_edges AS (SELECT e.project, e.a, e.b FROM ends e JOIN core x ON e.a = x.id JOIN core y ON e.b = y.id WHERE e.a < e.b), {closure('inner_edges', 'linked')},
cores AS (SELECT b.project, b.id, coalesce(l.cluster, b.id) AS cluster FROM crowd b JOIN core c ON b.id = c.id LEFT JOIN linked l ON b.id = l.id)
SELECT * FROM cores UNION ALL SELECT e.project, e.a, min(c.cluster) FROM ends e JOIN cores c ON e.b = c.id ANTI JOIN core x ON e.a = x.id GROUP BY 1, 2""",
    "crowd_neighbours": f"{_crowds} SELECT a AS id, count(*) AS n, min(b) AS least FROM pairs WHERE meters <= 60 GROUP BY 1",
    "temporal_counts_12h": SQL["temporal_pairs_12h"],
    "recommend_by_boxes": SQL["recommend_top12"],
    "itemsets_wide": SQL["itemsets"],
    "preview_ids_ranges": SQL["preview_ids"],
    "group_cards_two_level": SQL["group_cards"],
    "moments_two_level": SQL["moments_list"],
    "retention_skewed": """WITH docs AS (SELECT doc_id AS id, n_chars AS size, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN 77 ELSE (doc_id * 7919) % 100003 END AS recency FROM documents)
SELECT id, sum(size) OVER (ORDER BY recency DESC NULLS LAST, id DESC) <= (SELECT sum(size) * 3 // 4 FROM docs) AS keep FROM docs""",
    "geocode_tracks": f"""{BASE}, vertices AS (SELECT project, lon, lat, lag(lon) OVER v AS a, lag(lat) OVER v AS b, last_value(lon) OVER w AS c, last_value(lat) OVER w AS d FROM base WHERE lat IS NOT NULL AND project % 50 = 0
  WINDOW v AS (PARTITION BY project ORDER BY ts, id), w AS (PARTITION BY project ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
sides AS (SELECT project, lon AS x1, lat AS y1, coalesce(a, c) AS x2, coalesce(b, d) AS y2 FROM vertices),
met AS (SELECT p.id, s.project FROM base p JOIN sides s ON (s.y1 > p.lat) <> (s.y2 > p.lat) WHERE p.lat IS NOT NULL AND p.lon < (s.x2 - s.x1) * (p.lat - s.y1) / (s.y2 - s.y1) + s.x1 GROUP BY p.id, s.project HAVING count(*) % 2 = 1)
SELECT id, 'P' || min(project) AS iso FROM met GROUP BY id""",
    "geocode_simplified": SQL["geocode"],
    "rollups_followed": _followed,
    "directory_listing": "SELECT CAST(0 AS BIGINT) AS project, min(doc_id) AS id, '/data/' || source AS path, 'idle' AS status FROM documents WHERE source IS NOT NULL GROUP BY source",
    "grid_rows": f"""{BASE} SELECT id, file_name, folder_name, ts, CAST(NULL AS VARCHAR) AS tz_offset, country_code, round(lat, 5) AS lat, round(lon, 5) AS lon, CAST(NULL AS VARCHAR) AS camera_make, camera_model,
CAST(NULL AS INTEGER) AS width, CAST(NULL AS INTEGER) AS height, CAST(NULL AS VARCHAR) AS format, CAST(NULL AS BOOLEAN) AS writable FROM base""",
    "content_hashes": "SELECT '/files/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.webp' WHEN 1 THEN '.heic' ELSE '.png' END AS path, sha256(coalesce(text, '')) AS content_hash FROM documents",
}
