"""The catalog that stands in for a photo collection: the driver's events joined with parts, and two listings of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.keywords import folder_keywords

# One text for both engines; only the JSON accessor differs.
_CATALOG = """
SELECT e.event_id AS id, e.user_id AS project, e.ts AS ts, CONCAT('IMG_', CAST(e.event_id AS STRING), '.jpg') AS file_name,
       CONCAT(p.p_name, ' ', p.p_type, CASE WHEN (DAY(e.ts) + e.user_id) % 30 < 8 THEN ' Vacation Summer ' ELSE ' City Weekend ' END,
              '2024-01-', CAST(DAY(e.ts) AS STRING)) AS folder_name,
       e.event_type AS camera_model,
       CASE WHEN e.event_type = 'error' THEN NULL
            ELSE (e.user_id * 7) % 120 - 60 + CAST(<K> AS INT) * CAST(0.00050137 AS DOUBLE)
                 + CASE WHEN (DAY(e.ts) + e.user_id) % 30 < 8 THEN CAST(12 AS DOUBLE) + (DAY(e.ts) % 4) * CAST(0.5 AS DOUBLE)
                        ELSE CAST(0 AS DOUBLE) END END AS lat,
       CASE WHEN e.event_type = 'error' THEN NULL ELSE (e.user_id * 13) % 320 - 160 + e.value * CAST(0.000100137 AS DOUBLE) END AS lon,
       CASE WHEN e.event_type = 'error' THEN NULL
            WHEN (DAY(e.ts) + e.user_id) % 30 < 8 THEN CONCAT('NATION_', CAST((e.user_id + 1) % 25 AS STRING))
            ELSE CONCAT('NATION_', CAST(e.user_id % 25 AS STRING)) END AS country_code,
       'active' AS status
FROM <EVENTS> e JOIN <PART> p ON p.p_partkey = (e.user_id * 31 + DAY(e.ts)) % (SELECT COUNT(*) FROM <PART>)
"""
DUCK_CATALOG = _CATALOG.replace("<K>", "json_extract_string(e.props, '$.k')").replace("<EVENTS>", "events").replace("<PART>", "part")
_SPARK_CATALOG = _CATALOG.replace("<K>", "get_json_object(e.props, '$.k')").replace("<EVENTS>", "{events}").replace("<PART>", "{part}")

_SNAP_CATALOG = """
SELECT 0 AS project, doc_id AS id, CONCAT(source, '/', CAST(doc_id AS STRING), '.txt') AS path, n_chars AS size, 1000000 + doc_id AS mtime, <SHA> AS content_hash,
       CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'active' END AS status
FROM <DOCS> WHERE doc_id % 10 <> 0
"""
_SNAP_DISK = """
SELECT 0 AS project, CASE WHEN doc_id % 7 = 0 THEN CONCAT('moved/', CAST(doc_id AS STRING), '.txt') ELSE CONCAT(source, '/', CAST(doc_id AS STRING), '.txt') END AS path,
       n_chars AS size, 1000000 + doc_id + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, <SHA> AS content_hash
FROM <DOCS> WHERE doc_id % 11 <> 0
"""
DUCK_SNAP_CATALOG, DUCK_SNAP_DISK = (s.replace("<SHA>", "sha256(text)").replace("<DOCS>", "documents") for s in (_SNAP_CATALOG, _SNAP_DISK))

#: Boundary polygons: ordinal, iso, rings of [lon, lat]. The order decides where they overlap.
POLYGONS = [
    (0, "AA", [[[-160, -60], [-60, -60], [-60, 0], [-160, 0]]]),
    (1, "BB", [[[-60, -60], [60, -60], [60, -20], [0, -20], [0, 20], [-60, 20]]]),
    (2, "CC", [[[-20, -40], [40, -40], [40, 10], [-20, 10]]]),
    (3, "DD", [[[60, 0], [110, 0], [110, 40], [60, 40]], [[120, 0], [160, 0], [160, 40], [120, 40]]]),
    (4, "EE", [[[-160, 10], [-60, 10], [-110, 70]]]),
    (5, "FF", [[[0, 40], [60, 40], [30, 75]]]),
]


#: The placed base rows moved into 16 crowds of two projects, some 300 m wide each, 2 km apart.
CROWDS = """
SELECT project % 2 AS project, id, ts, CAST(10 AS DOUBLE) + floor(a * 4) * CAST(0.02 AS DOUBLE) + (a * 4 - floor(a * 4)) * CAST(0.003 AS DOUBLE) AS lat,
       CAST(20 AS DOUBLE) + floor(b * 4) * CAST(0.02 AS DOUBLE) + (b * 4 - floor(b * 4)) * CAST(0.003 AS DOUBLE) AS lon
FROM (SELECT project, id, ts, lat - floor(lat) AS a, lon - floor(lon) AS b FROM <BASE> WHERE lat IS NOT NULL) AS placed
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK_CATALOG, events=table(spark, sf_dir, "events"), part=table(spark, sf_dir, "part"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(catalog, disk listing)."""
    texts = [s.replace("<SHA>", "sha2(text, 256)").replace("<DOCS>", "{documents}") for s in (_SNAP_CATALOG, _SNAP_DISK)]
    documents = table(spark, sf_dir, "documents")
    return tuple(spark.sql(t, documents=documents) for t in texts)


def boundaries(spark: SparkSession) -> DataFrame:
    rows = [(o, iso, [[float(x) for x in v] for v in ring]) for o, iso, rings in POLYGONS for ring in rings]
    return spark.createDataFrame(rows, "ordinal INT, iso STRING, ring ARRAY<ARRAY<DOUBLE>>")


def tag_links(photos: DataFrame) -> DataFrame:
    """project, id, name: each row's folder keywords as its tags."""
    from pyspark.sql import functions as F

    return photos.select("project", "id", F.explode(folder_keywords(F.col("folder_name"))).alias("name"))


def crowds(base: DataFrame) -> DataFrame:
    return base.sparkSession.sql(CROWDS.replace("<BASE>", "{base}"), base=base)
