"""File inventories, and content hashes that ignore metadata."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from ..functions.labels import READ_ONLY, WRITABLE, file_format

IGNORED = ("tmp", "lock", "bak")


def _literal(path: str) -> str:
    """``path`` with the characters escaped that would match others."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)


def _hidden(spark: SparkSession, root: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Folders below ``root`` that begin with an underscore, and (path, size, mtime) of files that begin with an underscore or a dot: what Spark's listing hides.

    Folders that begin with a dot are left out with all that is in them. Names are matched by the file system, a level at a time, on the driver,
    which holds the names of a level (as Spark's own listing does) and the matches.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    base = hadoop(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(base).toString()
    escaped = _literal(top)
    folders, files, level = [], [], ""
    while len(fs.globStatus(hadoop(f"{escaped}{level}/*")) or ()):
        for found in fs.globStatus(hadoop(f"{escaped}{level}/[_.]*")) or ():
            path = found.getPath().toString()
            *above, name = path.removeprefix(top).strip("/").split("/")
            if any(a.startswith(".") for a in above):
                continue
            if not found.isDirectory():
                files.append((path, found.getLen(), found.getModificationTime()))
            elif name.startswith("_"):
                folders.append(path)
        level += "/*"
    return folders, files


def discover(spark: SparkSession, root: str, nested_projects: DataFrame | None = None) -> DataFrame:
    """path, size, mtime (ms) of the image files under a root; no content is read.

    ``nested_projects``: column ``root``, folders of other projects, whose files are left out. ``node_modules`` and folders that begin with a dot are
    left out; names that begin with an underscore, and files that begin with a dot, are listed, though Spark's sources can't read files of such names.
    """
    folders, hidden = _hidden(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([_literal(p) for p in (root, *folders)])
    files = files.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"))
    files = files.unionByName(spark.createDataFrame(hidden, "path STRING, size LONG, mtime LONG")) if hidden else files
    kept = files.where(file_format(F.col("path")).isin(*WRITABLE, *READ_ONLY) & ~F.col("path").contains("/node_modules/"))
    if nested_projects is None:
        return kept
    # every folder above a file is a key, so that nesting is an equi-join
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    inside = kept.select("path", F.explode(above).alias("root")).join(nested_projects.select("root"), "root", "left_semi").select("path").distinct()
    return kept.join(inside, "path", "left_anti")


def _jpeg(data: bytes) -> list[bytes] | None:
    """From the start of scan on."""
    if data[:2] != b"\xff\xd8":
        return None
    pos = 2
    while pos + 1 < len(data) and data[pos] == 0xFF:
        marker = data[pos + 1]
        if marker == 0xFF:
            pos += 1
        elif marker == 0xDA:
            return [data[pos:]]
        elif marker in (0x01, 0xD9) or 0xD0 <= marker <= 0xD7:
            pos += 2
        else:
            size = int.from_bytes(data[pos + 2 : pos + 4], "big") if pos + 4 <= len(data) else 0
            if size < 2:
                return None
            pos += 2 + size
    return None


def _png(data: bytes) -> list[bytes] | None:
    """All chunks but text, EXIF and time."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    pos, kept = 8, []
    while pos + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, pos)
        if pos + 12 + size > len(data):
            return None
        if kind not in (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME"):
            kept.append(data[pos : pos + 12 + size])
        pos += 12 + size
        if kind == b"IEND":
            break
    return kept


def _webp(data: bytes) -> list[bytes] | None:
    """The bodies of all chunks but EXIF, colour profile and XMP."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        return None
    pos, kept = 12, []
    while pos + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, pos)
        if pos + 8 + size > len(data):
            return None
        if kind not in (b"EXIF", b"ICCP", b"XMP "):
            kept.append(data[pos + 8 : pos + 8 + size])
        pos += 8 + size + size % 2
    return kept


CONTAINERS = {"jpg": _jpeg, "jpeg": _jpeg, "png": _png, "webp": _webp}


def image_hash(kind: str | None, data: bytes) -> str:
    """SHA-256 of the image stream; of the whole file for other formats and for files that don't parse."""
    parts = CONTAINERS[kind](data) if kind in CONTAINERS else None
    digest = hashlib.sha256()
    for part in [data] if parts is None else parts:
        digest.update(part)
    return digest.hexdigest()


def content_hashes(files: DataFrame) -> DataFrame:
    """path, content_hash of a ``binaryFile`` table: native SHA-256 where metadata can't be told apart, one Arrow pass for the three containers."""
    rows = files.select("path", file_format(F.col("path")).alias("format"), "content")
    parsed = F.coalesce(F.col("format").isin(*CONTAINERS), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [image_hash(k.as_py(), c.as_py() or b"") for k, c in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.string())], ["path", "content_hash"])

    whole = rows.where(~parsed).select("path", F.sha2("content", 256).alias("content_hash"))
    return arrow_map(rows.where(parsed), run, "path string, content_hash string").unionByName(whole)
