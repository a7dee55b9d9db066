"""MinHash near-duplicates whose candidates are verified by odd sketches.

1. Bands. A set of shingles keeps the least value of each of ``bands * rows`` hash functions, and ``rows`` of these are a band's key; sets with an equal key in
   any band are candidates. With 60 bands of 5 rows a pair at similarity 0.8 is in none of them once in 2 x 10^10, a pair at 0.1 in any
   once in 1,700.
2. Odd sketches. The ``SAMPLES`` least hashes of a set (its bottom-k MinHash samples; all of a set that isn't larger) are folded by hash into a bitmap of
   parities. What two sets share cancels in the XOR of their bitmaps, so its population count tells how many samples differ, and hardly errs where few
   do: it never exceeds their number. For sets within ``SAMPLES`` the bound on it loses no link; for larger ones it allows for ``DEVIATIONS`` standard
   deviations of the sample. Candidates above the bound go.
3. Full sets confirm what is left; links make components.

Candidates of a band's key meet its smallest node only, so a group costs one comparison a member, not all pairs. All candidates of the smallest nodes in one component
are a region. A region that holds several components is joined again: about sixteen of its members meet those of other components, then sixteen times as many
each round, until every pair that shares a key is in one component or compared. So members that link with many others, as near copies do, join
early, and few are left for the later rounds. XOR decides nearly all of these comparisons, inside the join; in a group of sets that are alike, but not
linked, their number grows with the group's square.

Equal sets are one node: a 64-bit hash of the set, told apart by 64 more where two sets share it. Shingles are known by 64-bit hashes.

Defined results: null and empty texts, and texts without words, have no shingle, link with nothing and are kept. A null doc_id takes part
like others; a component's id is its smallest doc_id that is not null, and a row with a null doc_id is kept only where its component has no other. Repeated rows are copies
that share a doc_id, so all or none of them are kept. An empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import dropped
from .common import arrow_map, stored, table
from .jaccard import _sets, _shared, shingle_set, small
from .packing import CHUNK, SLOTS, buckets_for, packed, pairs_of_shared
from .sketches import BITS, differing, most_differing, odd_sketch

BANDS, ROWS = 60, 5
#: Samples that are folded into a sketch, and standard deviations of a large set's sample that a candidate may lie below the threshold.
SAMPLES, DEVIATIONS = 1024, 6
#: Members of a region that meet the others in its first round, and how many times more in each later one.
PIVOTS = 16
#: Elements of a block while samples are taken (4 bytes each).
BLOCK = 1 << 18

_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M[2]
    return (h ^ (h >> np.uint64(29))) * _M[3]


def functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and masks of ``k`` fixed hash functions of 32 bits."""
    at = np.arange(1, k + 1, dtype=np.uint64)
    return (_mixed(at * _M[0]) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_mixed(at * _M[1]) >> np.uint64(32)).astype(np.uint32)


def samples(shingles: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The least value of each function over a set that isn't empty."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    wide = max(1, BLOCK // max(1, min(len(x), BLOCK)))
    for at in range(0, len(x), BLOCK):
        part = x[None, at : at + BLOCK]
        for f in range(0, len(factors), wide):
            own = slice(f, f + wide)
            np.minimum(out[own], ((part ^ masks[own, None]) * factors[own, None]).min(axis=1), out=out[own])
    return out


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    by = least.reshape(bands, -1).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(by.shape[1]):
        h = _mixed(h * _M[0] + by[:, i])
    return h


def sample_sketch(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Odd sketch of a sorted set's least hashes."""
    return odd_sketch(shingles[:SAMPLES], bits)


def estimate(count: float, a: int, b: int, bits: int = BITS) -> float:
    """Similarity of two sets of ``a`` and ``b`` elements, no more than ``SAMPLES``, whose sketches differ in ``count`` bits."""
    differ = -bits / 2 * math.log(1 - 2 * count / bits) if 2 * count < bits else a + b
    return max(0.0, (a + b - differ) / (a + b + differ))


def most_bits(a: Column, b: Column, num: int, den: int, bits: int = BITS) -> Column:
    """The largest population count that the sketches of two linked sets of ``a`` and ``b`` elements have (of larger ones but for a chance)."""
    total, larger, smaller = a + b, F.greatest(a, b), F.least(a, b)
    share = F.least(F.lit(1.0), total * (num / (den + num)) / larger)  # at least so much of the larger set is in both
    both = SAMPLES * share - DEVIATIONS * F.sqrt(SAMPLES * share * (1 - share)) - 1
    sampled = SAMPLES + F.least(smaller, F.lit(SAMPLES)) - 2 * both
    mean = bits / 2 * (1 - F.exp(-2 * sampled / bits))
    return F.when(larger <= SAMPLES, most_differing(a, b, num, den)).otherwise(F.ceil(F.least(sampled, mean + DEVIATIONS * F.sqrt(mean) / 2)))


def _digests(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, masks = functions(bands * rows)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, found = batch.slice(at, 1024), []
                for text in part.column(2):
                    s = shingle_set(text.as_py(), n)
                    if not len(s):
                        found.append((0, None, None, None, None))
                        continue
                    h = xxhash.xxh3_128_intdigest(s.tobytes())
                    low, high = np.array([h & (1 << 64) - 1, h >> 64], np.uint64).view(np.int64).tolist()
                    found.append((len(s), low, high, band_keys(samples(s, factors, masks), bands).view(np.int64), sample_sketch(s)))
                columns = [pa.array([r[i] for r in found], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "text_hash", "n_shingles", "low", "high", "keys", "sketch"])

    return run


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a column ``node``: ``low``, but a hash of ``low`` and ``high`` where sets that differ share ``low``."""
    shared = rows.where("low is not null").groupBy("low").agg(F.min("high").alias("a"), F.max("high").alias("b")).where("a <> b").select("low", F.lit(True).alias("__shared"))
    if shared.isEmpty():
        return rows.withColumn("node", F.col("low"))
    return rows.join(shared, "low", "left").withColumn("node", F.when(F.col("__shared"), F.xxhash64("low", "high")).otherwise(F.col("low"))).drop("__shared")


def _packed_keys(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task's rows
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                nodes, keys = batch.column(0).slice(at, CHUNK).to_pylist(), batch.column(1).slice(at, CHUNK)
                new = [i for i, n in enumerate(nodes) if n not in seen and not seen.add(n)]
                if new:
                    own = [keys[i].values.to_numpy().view(np.uint64) for i in new]
                    yield from packed(np.array([nodes[i] for i in new], np.int64), np.array(list(map(len, own))), np.concatenate(own), buckets, True)

    return run


def _shared_keys(rows: pa.Table) -> pa.Table:
    key, node = pairs_of_shared(rows, marked=False)
    return pa.table({"key": key, "node": node})


class OddSketchJoin:
    """Links between documents whose sets of ``n``-word shingles have a Jaccard similarity of at least ``num`` / ``den``."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text"):
        self.num, self.den = num, den
        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
        schema = "doc_id bigint, text_hash bigint, n_shingles bigint, low bigint, high bigint, keys array<bigint>, sketch array<bigint>"
        #: doc_id, n_shingles, node (null without shingles) and more of every row
        self.rows = numbered(stored(arrow_map(texts, _digests(n, bands, rows), schema)))
        nodes = self.rows.where("node is not null")
        buckets = buckets_for(self.rows.count() * bands)
        shared = arrow_map(nodes.select("node", "keys"), _packed_keys(buckets), SLOTS).groupBy("slot").applyInArrow(_shared_keys, "key bigint, node bigint")
        shared = stored(shared.distinct())
        first = shared.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot")
        met = stored(shared.join(first, "key").where("node <> pivot").select("pivot", "node").distinct())
        used = small(stored(met.select("node").unionByName(met.select(F.col("pivot").alias("node"))).distinct()))
        held = stored(nodes.join(used, "node", "left_semi").dropDuplicates(["node"]).select("node", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("n_shingles").alias("size"), "sketch"))
        chosen = small(held.select("node", "__id", "__hash"))
        own = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("node", "text").dropDuplicates(["node"])
        self.sets = stored(arrow_map(own, _sets(n), "node bigint, shingles binary"))
        self.sketches = held.select("node", "size", "sketch")
        self.links, self.roots = self._joined(met)
        dropped(shared, met, held, self.sets)

    def _may_link(self, shared: Column, sizes: Column) -> Column:
        return shared * self.den >= (sizes - shared) * self.num

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs (a, b with a_size, a_sketch, ...) whose sizes and sketches allow a link and whose full sets do link."""
        a_size, b_size = F.col("a_size"), F.col("b_size")
        near = self._may_link(F.least(a_size, b_size), a_size + b_size) & (differing("a_sketch", "b_sketch") <= most_bits(a_size, b_size, self.num, self.den))
        pairs = stored(pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = self.sets.join(used, "node", "left_semi")
        both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
        counted = arrow_map(both.select("a", "b", "x", "y"), _shared, "a bigint, b bigint, shared bigint, n_a bigint, n_b bigint")
        links = stored(counted.where(self._may_link(F.col("shared"), F.col("n_a") + F.col("n_b"))).select("a", "b"))
        dropped(pairs)
        return links

    def _side(self, name: str) -> DataFrame:
        return self.sketches.select(F.col("node").alias(name), F.col("size").alias(f"{name}_size"), F.col("sketch").alias(f"{name}_sketch"))

    def _joined(self, met: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links enough to connect what is linked, and (node, root) of the nodes that have any."""
        pairs = met.select(F.col("pivot").alias("a"), F.col("node").alias("b")).join(self._side("a"), "a").join(self._side("b"), "b")
        links = fresh = self._linked(pairs)
        state = met.unionByName(met.select("pivot", F.col("pivot").alias("node"))).select(F.col("pivot").alias("region"), "node")
        roots, spent, wanted = None, [], PIVOTS
        while True:
            if roots is None or not fresh.isEmpty():
                bound = fresh if roots is None else roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(fresh)
                spent += [roots] if roots is not None else []
                roots = stored(components(bound))
            rooted = state.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            merged = rooted.join(roots.select(F.col("node").alias("region"), F.col("root").alias("__to")), "region", "left")
            merged = stored(merged.select(F.coalesce("__to", "region").alias("region"), "node", "root").distinct())
            count = merged.groupBy("region").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("region", "n")
            picked = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.floor(F.col("n") / wanted)))  # about as many as are wanted, all of them in the end
            several = stored(merged.join(count, "region").withColumn("chosen", picked == 0))
            dropped(merged, *spent)
            if several.isEmpty():
                dropped(several)
                return links, roots
            a = several.where("chosen").select("region", F.col("node").alias("a"), F.col("root").alias("a_root")).join(self._side("a"), "a")
            b = several.select("region", F.col("node").alias("b"), F.col("root").alias("b_root")).join(self._side("b"), "b")
            fresh = self._linked(a.join(b, "region").where("a_root <> b_root"))
            links, wanted = links.unionByName(fresh), wanted * PIVOTS
            state, spent = several.where(~F.col("chosen")).select("region", "node"), [several]

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept of every row."""
        least = self.rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        rooted = least.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = self.rows.select("doc_id", "n_shingles", "node").join(rooted.join(ids, "root").select("node", "component_id"), "node", "left")
        component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        return named.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_odd_sketches(spark, sf_dir):
    return OddSketchJoin(table(spark, sf_dir, "documents"), 2, 80, 100).documents()


#: All pairs of documents that share a shingle, and the closure of their links: affordable only on small tables.
OP13_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM docs WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
named AS (
  SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least_other, d.doc_id)) AS component_id
  FROM docs d LEFT JOIN sizes z ON d.doc_id = z.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least_other FROM reach GROUP BY doc_id) r ON d.doc_id = r.doc_id)
SELECT *, doc_id = component_id AS kept FROM named
"""
