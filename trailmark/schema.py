"""Schemas of the catalog's tables, as DDL. ``project`` isolates catalogs from one another; every key starts with it."""

PHOTOS = (
    "project BIGINT, id BIGINT, directory_id BIGINT, file_path STRING, file_name STRING, folder_name STRING, file_size BIGINT, mtime BIGINT, "
    "content_hash STRING, format STRING, writable BOOLEAN, ts TIMESTAMP_NTZ, tz_offset STRING, country_code STRING, lat DOUBLE, lon DOUBLE, altitude DOUBLE, "
    "camera_make STRING, camera_model STRING, orientation INT, width INT, height INT, status STRING"
)
DIRECTORIES = ("project BIGINT, id BIGINT, path STRING, status STRING, last_scanned_at TIMESTAMP_NTZ")
TAGS = ("project BIGINT, tag_id BIGINT, name STRING, type STRING")
PHOTO_TAGS = ("project BIGINT, id BIGINT, tag_id BIGINT")
THUMBNAILS = ("project BIGINT, id BIGINT, size_type STRING, file_path STRING, bytes BIGINT, last_accessed TIMESTAMP_NTZ")
CLUSTERS = ("project BIGINT, cluster_id BIGINT, name STRING, type STRING, radius_meters DOUBLE, center_lat DOUBLE, center_lon DOUBLE, custom_named BOOLEAN")
PHOTO_CLUSTERS = ("project BIGINT, id BIGINT, cluster_id BIGINT")
ROLLUPS = ("project BIGINT, period_type STRING, period_key STRING, photo_count BIGINT, countries ARRAY<STRING>, cameras ARRAY<STRUCT<camera: STRING, n: BIGINT>>")
TABLES = {"photos": PHOTOS, "directories": DIRECTORIES, "tags": TAGS, "photo_tags": PHOTO_TAGS, "thumbnail_cache": THUMBNAILS, "clusters": CLUSTERS, "photo_clusters": PHOTO_CLUSTERS, "timeline_rollups": ROLLUPS}

#: Columns that grids show.
GRID = ["id", "file_name", "folder_name", "ts", "tz_offset", "country_code", "lat", "lon", "camera_make", "camera_model", "width", "height", "format", "writable"]
