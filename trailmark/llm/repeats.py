"""Substring dedup with fixed-block anchors.

A repeat is a stretch of at least ``window`` words (13) that also starts in a document with a smaller doc_id. Any such stretch holds
a whole aligned block of ``block`` words (7 = (13 + 1) / 2) of the other document, wherever it begins there. So:

1. Index and probe: each document's non-overlapping blocks are the index, all its rolling stretches of block length the probes. Both go to
   buckets by hash, a probe in some five bytes; a bucket holds about ``packing.BUCKET`` probes whatever the size of the corpus, since
   the number of buckets follows the number of words. Equal stretches are sent once a document, and once for every
   ``packing.CHUNK`` documents: the others of a chunk go straight to their own document's list.
2. A stretch that two documents hold and that is a whole block of one of them is an anchor in all of them (and what two documents of a chunk hold).
3. Extension: the windows around anchors meet by the 64-bit hash of their 13 words, and each window whose hash has a smaller
   document is a repeat. Here, too, only a chunk's smallest document meets the other chunks. Overlapping windows together are the maximal exact repeats;
   their words go.

No pair of documents is ever formed, and a passage that many documents share costs one row a document and word, of which one in a chunk goes
to its key's task. Anchors are candidates only; windows are equal if their 64-bit hashes are (one false window is to be expected among some 6 billion different ones).

Defined results: null texts have no words; texts under 13 words keep all; a null doc_id counts as larger than all others; rows with one
doc_id do not remove from one another; repeated rows lose the same words; an empty table gives an empty table. Texts
beyond the words that fit one task's memory (tens of millions) are the only bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, stored, table, words_of
from .packing import CHUNK, SLOTS, bucketed, buckets_for, packed, pairs_of_shared

WINDOW = 13
#: Lists of documents up to this many rows (16 bytes each) are sent to all executors; longer ones are joined by shuffle.
BROADCAST_ROWS = 500_000
LAST = (1 << 63) - 1

_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


def word_hashes(text: str | None) -> np.ndarray:
    return np.array(list(map(xxhash.xxh3_64_intdigest, words_of(text))), np.uint64)


def rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every stretch of ``n`` words."""
    m = max(0, len(words) - n + 1)
    h = np.full(m, n, np.uint64)
    for i in range(n):
        h = h * _M[0] + words[i : m + i]
        h = (h ^ (h >> np.uint64(31))) * _M[1]
    return (h ^ (h >> np.uint64(29))) * _M[2]


def _probes(window: int, buckets: int):
    block = (window + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                hashes = [rolling(w, block) if len(w := word_hashes(text.as_py())) >= window else w[:0] for text in part.column(1)]
                counts = np.array(list(map(len, hashes)))
                if counts.sum():
                    aligned = np.concatenate([np.arange(n) % block == 0 for n in counts])
                    yield from packed(part.column(0).to_numpy(), counts, np.concatenate(hashes), buckets, True, aligned)

    return run


def _anchors(rows: pa.Table) -> pa.Table:
    """(who, anchor) of one slot."""
    anchor, who = pairs_of_shared(rows, marked=True)
    return pa.table({"who": who, "anchor": anchor})


def _windows(window: int, buckets: int):
    block = (window + 1) // 2
    schema = pa.schema([("hash", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("slot", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                out = []
                for doc, tag, text, anchors in zip(*(c.slice(at, CHUNK) for c in batch.columns), strict=True):
                    words = word_hashes(text.as_py())
                    if len(words) < window:
                        continue
                    hit = np.isin(bucketed(rolling(words, block), buckets).astype(np.int64), anchors.values.to_numpy())
                    near = np.convolve(hit, np.ones(window - block + 1, np.int32), "valid") > 0
                    h = np.unique(rolling(words, window)[near].view(np.int64))  # a window that repeats within its document is sent once
                    out.append((h, np.full(len(h), doc.as_py(), np.int64), np.full(len(h), tag.as_py(), np.int64)))
                if out:
                    h, doc, tag = (np.concatenate(x) for x in zip(*out, strict=True))
                    order = np.lexsort((doc, h))
                    by = h[order]
                    start = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1])))[: len(h)]
                    least = np.empty_like(doc)
                    least[order] = np.repeat(doc[order][start], np.diff(np.append(start, len(h))))
                    slot = np.where(doc > least, 1 + (doc & 0x3FF), 0)  # 0 for the chunk's smallest document; rows stay by document, which packs well
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, doc, tag, slot)], schema=schema)

    return run


def _cut(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for text, repeated in zip(part.column(1), part.column(2), strict=True):
                    words = words_of(text.as_py())
                    n = len(words)
                    if repeated.is_valid:
                        edges = np.zeros(n + 1, np.int64)
                        first = np.flatnonzero(np.isin(rolling(word_hashes(text.as_py()), window).view(np.int64), repeated.values.to_numpy()))
                        np.add.at(edges, first, 1)
                        np.add.at(edges, first + window, -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
                    out.append((n, n - len(words), b" ".join(words).decode()))
                arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)] if out else []
                if out:
                    yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    return run


def _joined(docs: DataFrame, lists: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` with their lists, and the rest (None: it is among the first, with null lists).

    Where the listed documents are counted to be few, only their texts are shuffled.
    """
    listed = lists.select(*[F.col(k).alias(f"__{k}") for k in keys])
    if listed.count() > BROADCAST_ROWS:
        return docs.join(lists, keys, "left"), None
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    return docs.join(F.broadcast(listed), same, "left_semi").join(lists, keys), docs.join(F.broadcast(listed), same, "left_anti")


def repeats_removed(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) of every row."""
    tag = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))  # tells texts under one doc_id apart
    known = F.col(doc_id).cast("long")
    rows = docs.select(
        known.alias("doc_id"), F.coalesce(known, F.lit(LAST)).alias("doc"), F.coalesce(known, F.xxhash64(text)).alias("who"), tag.alias("tag"), F.col(text).alias("text")
    )
    letters = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = buckets_for(letters // 6)
    probes = arrow_map(rows.select("who", "text"), _probes(window, buckets), SLOTS)
    anchors = probes.groupBy("slot").applyInArrow(_anchors, "who bigint, anchor bigint")
    hits = stored(anchors.groupBy("who").agg(F.collect_list("anchor").alias("anchors")))  # bounded by one document's words
    near, _ = _joined(rows.select("who", "doc", "tag", "text"), hits, ["who"])
    near = near.where("anchors is not null").select("doc", "tag", "text", "anchors")
    windows = arrow_map(near, _windows(window, buckets), "hash bigint, doc bigint, tag bigint, slot bigint")
    first = windows.withColumn("first", F.min("doc").over(Window.partitionBy("hash", "slot"))).where("slot > 0 or doc > first")
    repeated = first.groupBy("doc", "tag").agg(F.collect_list("hash").alias("repeated"))  # bounded by one document's words
    changed, rest = _joined(rows, stored(repeated), ["doc", "tag"])
    changed = changed.select("doc_id", "text", "repeated")
    if rest is not None:
        changed = changed.unionByName(rest.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("repeated")))
    return arrow_map(changed, _cut(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def op7_fixed_block_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return repeats_removed(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window of 13 words with its first holder: affordable only on small tables.
OP7_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS s, w FROM docs WHERE len(w) >= 13),
windows AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS body FROM starts),
hit AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY body) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(s, s + 13)) AS i FROM hit)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
kept AS (
  SELECT x.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY x.i), '') AS kept
  FROM words x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
