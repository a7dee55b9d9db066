"""Boundary polygons: reading them, and building them from GeoJSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..arrow import arrow_map

RINGS = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
COUNTRIES = T.StructType([T.StructField("countries", T.ArrayType(T.StructType([T.StructField("iso", T.StringType()), T.StructField("name", T.StringType()), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("polys", RINGS)])))])
# Codes of countries that public data sets tag with -99.
ISO_BY_NAME = {"France": "FR", "Norway": "NO", "Kosovo": "XK", "Northern Cyprus": "CY", "Somaliland": "SO"}


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, iso, name, ring of a countries file, one row a ring; a missing file gives no row."""
    try:
        doc = spark.read.schema(COUNTRIES).json(path, multiLine=True)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "ordinal INT, iso STRING, name STRING, ring ARRAY<ARRAY<DOUBLE>>")
    each = doc.select(F.posexplode("countries").alias("ordinal", "c"))
    return each.select("ordinal", "c.iso", "c.name", F.explode("c.polys").alias("ring"))


def simplify(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Ramer-Douglas-Peucker: keeps the ends of a stretch and, while one lies beyond the tolerance, its farthest vertex."""
    keep = np.zeros(len(ring), bool)
    keep[[0, -1]] = True
    open_stretches = [(0, len(ring) - 1)]
    while open_stretches:
        a, b = open_stretches.pop()
        if b - a < 2:
            continue
        span, inner = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        length = span @ span
        along = np.clip(inner @ span / length, 0, 1) if length else np.zeros(len(inner))
        gaps = np.hypot(*(inner - along[:, None] * span).T)
        far = int(gaps.argmax())
        if gaps[far] > tolerance:
            keep[a + 1 + far] = True
            open_stretches += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.round(ring[keep], 4)


def build_boundaries(features: DataFrame, tolerance: float = 0.01, min_area: float = 0.02) -> DataFrame:
    """iso, name, bbox, polys from GeoJSON features (columns name, iso, geometry as JSON text), one row a country.

    Outer rings only; parts of under four vertices or of a box under ``min_area`` square degrees go, as do rings that simplify to under
    four vertices. Countries without a code get one by name or go.
    """
    by_name = F.create_map(*[F.lit(x) for p in ISO_BY_NAME.items() for x in p])
    code = F.upper(F.coalesce(F.when(~F.col("iso").isin("-99", ""), F.col("iso")), F.try_element_at(by_name, F.col("name"))))
    rows = features.select(code.alias("iso"), "name", "geometry").where("iso is not null and geometry is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for iso, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shape = json.loads(text)
                parts = [shape["coordinates"]] if shape.get("type") == "Polygon" else shape["coordinates"] if shape.get("type") == "MultiPolygon" else []
                for at, part in enumerate(parts):
                    ring = np.array(part[0], float)[:, :2] if part and part[0] else np.zeros((0, 2))
                    if len(ring) < 4 or np.prod(ring.max(0) - ring.min(0)) < min_area:
                        continue
                    ring = simplify(ring, tolerance)
                    if len(ring) >= 4:
                        out.append((iso, name, at, ring.tolist()))
            if out:
                types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["iso", "name", "part", "ring"])

    rings = arrow_map(rows, run, "iso string, name string, part int, ring array<array<double>>")
    edge = lambda f, g, i: F.round(f(g(F.transform("ring", lambda v: v[i]))), 4)
    polys = F.transform(F.array_sort(F.collect_list(F.struct("part", "ring"))), lambda x: x["ring"])
    return rings.groupBy("iso", "name").agg(F.array(edge(F.min, F.array_min, 0), edge(F.min, F.array_min, 1), edge(F.max, F.array_max, 0), edge(F.max, F.array_max, 1)).alias("bbox"), polys.alias("polys"))
