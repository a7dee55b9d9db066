"""Sources, sinks, content hashes, boundary building and streams."""

import json
import struct
import zlib
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from trailmark.operators.filters import base
from trailmark.operators.rollups import rollups
from trailmark.schema import GRID, TABLES
from trailmark.sources import boundary, inventory, tables
from trailmark.streaming.streams import ingest_catalog, ingest_stream, stream_sessions, touched_rollups


def png(*chunks):
    pack = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + b"".join(pack(k, d) for k, d in chunks)


def jpeg(meta, scan=b"pixels"):
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(meta) + 2) + meta + b"\xff\xff\xda\x00\x02" + scan


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_hash_ignores_metadata_only():
    h = inventory.image_hash
    assert h("jpg", jpeg(b"Exif1")) == h("jpeg", jpeg(b"Exif longer")) != h("jpg", jpeg(b"Exif1", b"other"))
    a = png((b"IHDR", b"x"), (b"tEXt", b"one"), (b"IDAT", b"data"), (b"IEND", b""))
    assert h("png", a) == h("png", png((b"IHDR", b"x"), (b"IDAT", b"data"), (b"IEND", b""))) != h("png", png((b"IHDR", b"x"), (b"IDAT", b"dat2"), (b"IEND", b"")))
    assert h("webp", webp((b"VP8 ", b"abc"), (b"EXIF", b"e"))) == h("webp", webp((b"VP8 ", b"abc"))) != h("webp", webp((b"VP8 ", b"abd")))
    for kind in ("jpg", "png", "webp", "heic", None):
        assert h(kind, b"not an image") == __import__("hashlib").sha256(b"not an image").hexdigest()


def test_inventory(spark, tmp_path):
    for name, data in {"a.jpg": jpeg(b"E"), "sub/b.PNG": b"x", "sub/c.txt": b"t", "node_modules/d.jpg": b"x", "nested/e.jpg": b"x", "nested/deep/f.webp": b"x", "h.heic": b"raw"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    names = lambda df: sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in df.collect())
    assert names(inventory.discover(spark, str(tmp_path))) == ["a.jpg", "h.heic", "nested/deep/f.webp", "nested/e.jpg", "sub/b.PNG"]
    nested = spark.createDataFrame([(f"file:{tmp_path}/nested",)], "root STRING")
    assert names(inventory.discover(spark, str(tmp_path), nested)) == ["a.jpg", "h.heic", "sub/b.PNG"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.content_hash for r in inventory.content_hashes(files).collect()}
    assert got["a.jpg"] == inventory.image_hash("jpg", jpeg(b"E")) and got["h.heic"] == inventory.image_hash("heic", b"raw")


def test_inventory_of_hidden_names(spark, tmp_path):
    """Names that begin with an underscore are listed at any depth, dot-files too; dot-folders are not."""
    kept = ["_x/a.jpg", "_x/sub/b.jpg", "sub/_y/c.jpg", "sub/_y/_z/d.png", "_e.jpg", ".f.jpg", "sub/deep/_g.webp", "sub/[odd] {name}/_h/i.jpg", "plain.jpg"]
    gone = [".git/a.jpg", ".git/_x/b.jpg", "sub/.cache/_c.jpg", "_x/.cache/d.jpg", "_x/node_modules/e.jpg", "_notes.txt"]
    for name in kept + gone:
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(name.encode())
    got = {r.path.removeprefix(f"file:{tmp_path}/"): r["size"] for r in inventory.discover(spark, str(tmp_path)).collect()}
    assert got == {n: len(n.encode()) for n in kept}


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "x", "idle", None), (2, 4, "y", "idle", None)], TABLES["directories"])
    tables.write_table(rows, str(tmp_path), "directories")
    assert [r.id for r in tables.directories(spark, str(tmp_path)).collect()] == [5, 4]
    version = tables.write_version(rows, str(tmp_path / "v"), "status")
    assert spark.read.parquet(version).count() == 2


def test_table_of_many_projects_takes_few_files(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") % 300).alias("project"), "id", F.lit("x").alias("path"), F.lit("idle").alias("status"), F.lit(None).cast("timestamp_ntz").alias("last_scanned_at"))
    tables.write_table(rows.unionByName(rows.limit(1).withColumns({"project": F.lit(None).cast("bigint"), "id": F.lit(-1).cast("bigint")})), str(tmp_path), "directories")
    assert len(list(tmp_path.rglob("*.parquet"))) <= 4
    back = tables.read_table(spark, str(tmp_path), "directories")
    assert back.columns == rows.columns and back.count() == 5001 and back.where("project is null").count() == 1
    assert sorted(r.id for r in back.where("project = 7").collect()) == list(range(7, 5000, 300))


def test_grid_of_many_projects_reads_few_files(spark, tmp_path):
    rows = spark.range(600).select((F.col("id") % 200).alias("project"), "id", F.lit("a.jpg").alias("file_name"), F.lit("active").alias("status"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"))
    tables.write_table(rows, str(tmp_path), "photos")
    grid = base(tables.read_table(spark, str(tmp_path), "photos")).select(*GRID)
    assert len(grid.inputFiles()) <= 4
    assert sorted((r.id, r.file_name, r.width) for r in grid.collect()) == [(i, "a.jpg", None) for i in range(600)]


def test_boundaries(spark, tmp_path):
    circle = [[10 * np.cos(a), 10 * np.sin(a)] for a in np.linspace(0, 2 * np.pi, 400)]
    small = [[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1], [0, 0]]
    features = [("Round", "rr", {"type": "Polygon", "coordinates": [circle, small]}), ("France", "-99", {"type": "MultiPolygon", "coordinates": [[small], [circle]]}), ("Nowhere", "-99", {"type": "Polygon", "coordinates": [circle]}), ("Tiny", "TT", {"type": "Polygon", "coordinates": [small]}), ("None", "NN", None)]
    df = spark.createDataFrame([(n, i, json.dumps(g) if g else None) for n, i, g in features], "name STRING, iso STRING, geometry STRING")
    got = {r.iso: r for r in boundary.build_boundaries(df).collect()}
    assert set(got) == {"RR", "FR"} and len(got["FR"].polys) == 1 and 20 < len(got["RR"].polys[0]) < 200
    assert got["RR"].bbox == [-10.0, -10.0, 10.0, 10.0] or max(abs(abs(x) - 10) for x in got["RR"].bbox) < 0.02
    ring = np.array(got["RR"].polys[0])
    assert (abs(np.hypot(*ring.T) - 10) < 0.001).all()
    path = tmp_path / "countries.json"
    path.write_text(json.dumps({"countries": [{"iso": r.iso, "name": r.name, "bbox": r.bbox, "polys": r.polys} for r in got.values()]}))
    assert boundary.read_boundaries(spark, str(path)).count() == 2 and boundary.read_boundaries(spark, str(tmp_path / "none.json")).count() == 0


def test_simplify_keeps_what_lies_off_the_line():
    line = np.array([[0, 0], [1, 0.001], [2, 0], [3, 1], [4, 0]], float)
    assert boundary.simplify(line, 0.01).tolist() == [[0, 0], [2, 0], [3, 1], [4, 0]]


def test_streams(spark, tmp_path):
    t0 = datetime(2024, 5, 1)
    made = [(1, i, t0 + timedelta(minutes=m), "FR", "A", "active") for i, m in enumerate((0, 30, 90, 200, 5000))]
    schema = "project LONG, id LONG, ts TIMESTAMP_NTZ, country_code STRING, camera_model STRING, status STRING"
    rows = spark.createDataFrame(made, schema)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, 3600, "1 minute").writeStream.outputMode("append").format("memory").queryName("sessions").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 3]  # the last session is still open
    seen = []
    ingest_stream(stream, lambda batch: seen.append(batch.count()), str(tmp_path / "cp")).awaitTermination()
    assert sum(seen) == 5
    whole = {(r.period_type, r.period_key): r.photo_count for r in rollups(rows).collect()}
    part = {(r.period_type, r.period_key): r.photo_count for r in touched_rollups(rows, rows.where(F.col("id") == 4)).collect()}
    assert part == {k: whole[k] for k in part} and set(k for k, _ in part) == {"decade", "year", "month"}


def test_ingest_keeps_the_catalog_in_step(spark, tmp_path):
    """Each batch holds whole listings of some projects: diff, moves and next state, and other projects stay as they are."""
    columns = "project LONG, path STRING, size LONG, mtime LONG, content_hash STRING"
    state = {"now": spark.createDataFrame([(1, 1, "a", 5, 5, "x", "active"), (1, 2, "b", 6, 6, "y", "active"), (2, 9, "z", 1, 1, "q", "active")], "project LONG, id LONG, path STRING, size LONG, mtime LONG, content_hash STRING, status STRING")}

    def publish(df):
        path = str(tmp_path / f"v{len(list(tmp_path.iterdir()))}")
        df.write.parquet(path)
        state["now"] = spark.read.parquet(path)

    for i, rows in enumerate([[(1, "a", 5, 5, "x"), (1, "c/b", 6, 7, "y"), (1, "d", 1, 1, "n")], [(1, "a", 9, 9, "w")]]):
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = ingest_catalog(spark.readStream.schema(columns).json(str(tmp_path / "in")), lambda: state["now"], publish, str(tmp_path / "check"))
        stream.awaitTermination(120)
        got = sorted((r.project, r.id, r.path, r.size, r.status) for r in state["now"].collect())
        if i == 0:
            assert got == [(1, 1, "a", 5, "active"), (1, 2, "c/b", 6, "active"), (1, 3, "d", 1, "active"), (2, 9, "z", 1, "active")]
    assert got == [(1, 1, "a", 9, "active"), (1, 2, "c/b", 6, "missing"), (1, 3, "d", 1, "missing"), (2, 9, "z", 1, "active")]
