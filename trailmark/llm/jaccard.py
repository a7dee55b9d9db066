"""N-gram Jaccard join: an exact similarity join in the metric space of Jaccard distances.

1. Parts. The shingle space is cut by hash into half as many parts again as the largest symmetric difference that a linked pair can have, so such a
   pair agrees in a third of them at least (pigeonhole). Where the bound depends on set sizes, overlapping size windows replicate
   sets near a window's edge. Sets that share no part's content with another are done; of the others' parts only the rarest count, as many as a set
   may differ in plus one: the rarest part in which a linked pair agrees is among these for both. So parts that a passage of many documents fills bring nobody together.
2. Own shingles. For the others the shingles that no other of them has are counted: none of these is in an intersection, so two sets share at most
   the smaller of their rests. Sets whose rest is too small for any partner of the part's sizes leave the part.
3. Regions. Each part's content chooses as pivot its member with the smallest share of own shingles (edits add own shingles, so it lies amid its
   copies). A pivot's region holds all sets that share such a part with it: a set belongs to its nearest pivot's region and is replicated to the
   regions of the other pivots that chance to be in reach. Two sets that link share a part, hence a region. Exact distances to the pivots make
   links, and links make components.
4. Windows and recursion. A region that still holds several components is joined again: pivots from all components but its largest (sixteen a
   region, then sixteen times as many each round) meet only members of other components inside their window. The window is that of the
   triangle inequality around the region's pivot c, taken apart by elements: two sets share at most the smaller of their shares of c, and outside c at most
   the smaller of their rests. Inside the window odd sketches of whole sets (``sketches``) bound the symmetric difference from below, which leaves few pairs
   but those that link, in groups of near copies at the threshold, too. A round retires its pivots; the rounds end when no region has a member
   left that is to become one.

Windows by distance alone (and cells of nearest pivots with a margin of twice the threshold) hold whole groups of near copies, which all lie at much the same
distance from one another; the windows by elements leave a small part of these pairs. Copies with equal shingle sets are one node throughout.
No pairs within a copied group are made: a group costs one comparison a member and pivot. Equal sets are known by a 64-bit hash, shingles
by a 64-bit hash of their words' 64-bit hashes.

Memory: a hot part or shingle is combined for every ``packing.CHUNK`` sets before it is shuffled, and buckets hold about ``packing.BUCKET`` keys.

Defined results: null and empty texts, and texts without words, have no shingle and link with nothing (their component is their own
doc_id). A null doc_id takes part like others; a component's id is its smallest doc_id that is not null. Repeated rows
are copies. An empty table gives an empty table. Sets and links do not depend on other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from ..scratch import dropped
from .common import WORD, arrow_map, stored, table, words_of
from .packing import CHUNK, SLOTS, buckets_for, packed, pairs_of_shared, unpacked
from .sketches import differing, most_differing, odd_sketch

#: Ratio of neighbouring size windows' lower ends.
STEP = 1.7
#: A list of nodes up to this many rows (24 bytes each) is sent to all executors; a longer one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Pivots of a region in the first round, and how many times more in each later one.
PIVOTS = 16
#: Slots of rows that hold the nodes' numbers of parts begin here, downwards.
COUNTS = -(1 << 20)

_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M[2]
    return (h ^ (h >> np.uint64(29))) * _M[3]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``n`` words, letters A-Z lowered; all words as one if there are fewer."""
    w = np.array(list(map(xxhash.xxh3_64_intdigest, words_of(text, lower=True))), np.uint64)
    if not len(w):
        return w
    width = min(n, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for i in range(width):
        h = _mixed(h * _M[0] + w[i : len(w) - width + 1 + i])
    return np.unique(h)


def node_of(shingles: np.ndarray) -> int:
    """The set's hash, as a signed 64-bit integer."""
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


@lru_cache(1 << 12)
def size_windows(size: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(window, parts, spare parts) that a set of this size takes part in: two windows at most, j and j - 1.

    Window j holds the pairs whose smaller set has STEP^j to STEP^(j+1) shingles; their larger sets have at most ``top``. Spare
    parts stand for empty ones: a set with no more empty parts than spare ones has more filled parts than a linked pair can differ in.
    """
    edge = lambda j: -int(-(STEP**j) // 1)  # noqa: E731  the smallest size of window j
    j, out = 0, []
    while edge(j + 1) <= size:
        j += 1
    while j >= 0 and size <= (top := (edge(j + 1) - 1) * den // num):
        if differ := (den - num) * top // den:  # without room for a difference only equal sets link
            parts = -(-(differ + 1) * 3 // 2) + 1
            out.append((j, parts, parts - differ - 1))
        j -= 1
    return out


def part_contents(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Hashes of the contents of a set's parts, in all its size windows; the last bit is the window's."""
    found = []
    for j, parts, spare in size_windows(len(shingles), num, den):
        at = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)  # sorted, as the hashes are
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        filled, sums = at[starts], np.add.reduceat(shingles, starts)
        if parts - len(filled) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), filled)
            filled, sums = np.concatenate((filled, empty)), np.concatenate((sums, np.zeros(len(empty), np.uint64)))
        found.append(_mixed(sums * _M[1] + filled * _M[0] + np.uint64(j)) & ~np.uint64(1) | np.uint64(j & 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _sizes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), n)
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["doc_id", "text_hash", "n_shingles", "node"])

    return run


def _contents(n: int, num: int, den: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # nodes of this task's rows
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                nodes, parts = [], []
                for text in batch.column(0).slice(at, CHUNK):
                    s = shingle_set(text.as_py(), n)
                    if not len(s) or (node := node_of(s)) in seen:
                        continue
                    seen.add(node)
                    nodes.append(node)
                    parts.append(part_contents(s, num, den))
                if any(map(len, parts)):
                    odd = np.array([int((x & np.uint64(1)).sum()) for x in parts], np.int64)
                    listed = np.array(list(map(len, parts)), np.int64)
                    row = (COUNTS - (nodes[0] & 0xFFF), -1, np.array(nodes, np.int64).tobytes(), (listed - odd).tobytes(), odd.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], ["slot", "bucket", "nodes", "counts", "keys"])
                    yield from packed(np.array(nodes, np.int64), np.array(list(map(len, parts))), np.concatenate(parts), buckets, True)

    return run


def _met(rows: pa.Table) -> pa.Table:
    """(part, node) of a slot's parts that two and more nodes have; for a slot of counts (node, parts0, parts1) without a part."""
    none = lambda n: pa.nulls(n, pa.int64())
    if rows.column(1)[0].as_py() < 0:
        node, even, odd = (np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in rows.column(i)]) for i in (2, 3, 4))
        return pa.table({"part": none(len(node)), "node": node, "parts0": even, "parts1": odd})
    part, node = pairs_of_shared(rows, marked=False)
    return pa.table({"part": part, "node": node, "parts0": none(len(node)), "parts1": none(len(node))})


def _sets(n: int, sketched: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingle_set(t.as_py(), n) for t in part.column(1)]
                columns = [part.column(0), pa.array([s.tobytes() for s in sets], pa.binary())]
                if sketched:
                    columns.append(pa.array([odd_sketch(s) for s in sets], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["node", "shingles", "sketch"][: len(columns)])

    return run


def _shingles(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.column(1)]
                if sets:
                    yield from packed(part.column(0).to_numpy(), np.array(list(map(len, sets))), np.concatenate(sets), buckets, False)

    return run


def _alone(rows: pa.Table) -> pa.Table:
    """(node, own): how many keys of the slot are in one row only."""
    node, key, flag, _ = unpacked(rows)
    differs = np.concatenate(([True], key[1:] != key[:-1], [True]))
    found, own = np.unique(node[differs[:-1] & differs[1:] & ~flag], return_counts=True)
    return pa.table({"node": found, "own": own})


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (batch.column(i) for i in (2, 3))
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            out.append((int((both[1:] == both[:-1]).sum()), len(a), len(b)))
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["a", "b", "shared", "n_a", "n_b"])


def small(df: DataFrame) -> DataFrame:
    """``df`` (a stored table), marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


class JaccardJoin:
    """Links between documents whose sets of ``n``-word shingles have a Jaccard similarity of at least ``num`` / ``den``."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text"):
        self.num, self.den = num, den
        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
        #: doc_id, text_hash, n_shingles, node (null without shingles) of every row
        self.sizes = stored(arrow_map(texts, _sizes(n), "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint"))
        total = self.sizes.agg(F.sum("n_shingles")).first()[0] or 0
        buckets = buckets_for(int(total * 0.4))  # a set has parts for about four in ten of its shingles
        parts = arrow_map(texts.select("text"), _contents(n, num, den, buckets), SLOTS).groupBy("slot").applyInArrow(_met, "part bigint, node bigint, parts0 bigint, parts1 bigint")
        parts = stored(parts.distinct())
        rows = self.sizes.where("node is not null").groupBy("node").agg(F.first("n_shingles").alias("size"), F.min(F.struct("doc_id", "text_hash")).alias("row"))
        met = stored(self._rarest(parts.where("part is not null").select("part", "node"), parts.where("part is null").select("node", "parts0", "parts1"), rows.select("node", "size")))
        members = stored(rows.join(met.select("node").distinct(), "node", "left_semi").select("node", "size", F.col("row.doc_id").alias("__id"), F.col("row.text_hash").alias("__hash")))
        chosen = small(members)
        held = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))).select("node", "text")
        #: node, shingles, sketch of every node that shares a rare part with another (twice for a row that repeats)
        self.sets = stored(arrow_map(held, _sets(n, True), "node bigint, shingles binary, sketch array<bigint>"))
        self.rounds = 0
        self.links, self.roots = self._joined(self._regions(met, members))
        dropped(parts, met, members, self.sets)

    def _rarest(self, met: DataFrame, counts: DataFrame, sizes: DataFrame) -> DataFrame:
        """part, node of each node's rarest parts in either window, where others have them, too.

        As many as a linked pair may differ in plus one; those that nobody else has are among them and have no row here.
        """
        odd = F.pmod("part", F.lit(2))
        mine = Window.partitionBy("node", "odd")
        held = met.groupBy("part").agg(F.count("*").alias("held"))
        listed = met.join(held, "part").join(counts.join(sizes, "node"), "node").withColumn("odd", odd)
        alone = F.when(F.col("odd") == 0, F.col("parts0")).otherwise(F.col("parts1")) - F.count("*").over(mine)
        room = F.expr(f"size * {self.den - self.num} div {self.num}") + 2  # one to spare, should two parts of a set have one key
        kept = listed.withColumns({"rank": F.row_number().over(mine.orderBy("held", "part")), "alone": alone}).where(F.col("alone") + F.col("rank") <= room).select("part", "node")
        kept = stored(kept)
        return kept.join(kept.groupBy("part").agg(F.count("*").alias("n")).where("n > 1"), "part", "left_semi")

    def _may_link(self, shared: Column, sizes: Column) -> Column:
        """Whether ``shared`` shingles of two sets of ``sizes`` together are enough."""
        return shared * self.den >= (sizes - shared) * self.num

    def _regions(self, met: DataFrame, members: DataFrame) -> DataFrame:
        """pivot, node and of both the size and the rest (shingles that others have, too): every node of each pivot's region."""
        total = members.agg(F.sum("size")).first()[0] or 0
        keys = arrow_map(self.sets.select("node", "shingles"), _shingles(buckets_for(total)), SLOTS).groupBy("slot").applyInArrow(_alone, "node bigint, own bigint")
        own = keys.groupBy("node").agg(F.sum("own").alias("own"))
        rest = F.col("size") - F.coalesce("own", F.lit(0))
        nodes = members.join(own, "node", "left").select("node", "size", rest.alias("rest"))
        largest = F.expr(f"rest * {self.num + self.den} div {self.num}") - F.col("size")  # a partner's size at most
        nodes = nodes.withColumn("most", largest).where(F.col("most") * self.den >= F.col("size") * self.num)
        rows = stored(met.join(small(stored(nodes)), "node"))
        first = F.struct((F.lit(1) - F.col("rest") / F.col("size")).alias("own"), F.col("node"), F.col("size"), F.col("rest"))
        parts = rows.groupBy("part").agg(F.min(first).alias("first"), F.min("size").alias("least"), F.count("*").alias("n")).where("n > 1")
        inside = rows.join(parts, "part").where("most >= least and node <> first.node")
        return inside.select(F.col("first.node").alias("pivot"), F.col("first.size").alias("p_size"), F.col("first.rest").alias("p_rest"), "node", "size", "rest").distinct()

    def _distances(self, pairs: DataFrame) -> DataFrame:
        """a, b, linked, shared (number of shingles) of pairs (a, b)."""
        used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = self.sets.select("node", "shingles").join(used, "node", "left_semi").dropDuplicates(["node"])
        both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
        counted = arrow_map(both.select("a", "b", "x", "y"), _shared, "a bigint, b bigint, shared bigint, n_a bigint, n_b bigint")
        return counted.select("a", "b", self._may_link(F.col("shared"), F.col("n_a") + F.col("n_b")).alias("linked"), "shared")

    def _joined(self, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All links that are needed to connect what is linked, and (node, root) of the nodes that have any."""
        regions = stored(regions)
        possible = self._may_link(F.least("rest", "p_rest"), F.col("size") + F.col("p_size"))
        pairs = regions.where(possible).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        found = stored(self._distances(stored(pairs)))
        sketches = self.sets.select("node", "sketch").dropDuplicates(["node"])
        links, tested, roots = found.where("linked").select("a", "b"), found.select("a", "b"), None
        near = found.select("a", "b", "shared")
        # a member's shingles in the pivot, exactly or at most, and at least as many of the others that it may share with a member outside the pivot
        state = regions.join(near, (F.least("node", "pivot") == F.col("a")) & (F.greatest("node", "pivot") == F.col("b")), "left")
        inside, exact = F.coalesce("shared", F.least("rest", "p_rest")), F.col("shared").isNotNull()
        state = stored(state.select("pivot", "node", "size", "rest", inside.alias("inside"), F.when(exact, F.col("rest") - F.col("shared")).otherwise(F.col("rest")).alias("outside")))
        fresh, wanted = links, PIVOTS
        while True:
            self.rounds += 1
            if roots is None or not fresh.isEmpty():
                bound = fresh if roots is None else roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(fresh)
                roots = stored(components(bound))
            rooted = state.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            count = rooted.groupBy("pivot", "root").agg(F.count("*").alias("n"))
            large = count.groupBy("pivot").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
            several = rooted.join(large.select("pivot", F.col("top.root").alias("large"), (F.col("n") - F.col("top.n")).alias("rest_of")), "pivot")
            several = stored(several.join(sketches, "node"))
            if several.isEmpty():
                return links, roots
            # by hash, about as many of those outside a region's largest component as are wanted, all of them in the end
            picked = F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.floor(F.col("rest_of") / wanted)))
            several = several.withColumn("chosen", (F.col("root") != F.col("large")) & (picked == 0))
            p = several.where("chosen").select("pivot", *[F.col(c).alias(f"p_{c}") for c in ("node", "root", "size", "rest", "inside", "outside", "sketch")])
            window = (F.col("root") != F.col("p_root")) & self._may_link(F.least("rest", "p_rest"), F.col("size") + F.col("p_size"))
            window &= self._may_link(F.least("inside", "p_inside") + F.least("outside", "p_outside"), F.col("size") + F.col("p_size"))
            window &= differing("sketch", "p_sketch") <= most_differing(F.col("size"), F.col("p_size"), self.num, self.den)
            pairs = several.join(p, "pivot").where(window).select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct()
            found = stored(self._distances(stored(pairs.join(tested, ["a", "b"], "left_anti"))))
            fresh = found.where("linked").select("a", "b")
            links, tested, wanted = links.unionByName(fresh), tested.unionByName(found.select("a", "b")), wanted * PIVOTS
            state = several.where(~F.col("chosen")).select(*state.columns)

    def classes(self) -> DataFrame:
        """node, component (its root) and component_id (the smallest doc_id in it) of every node."""
        nodes = self.sizes.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
        rooted = nodes.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        return rooted.join(ids, "root").select("node", F.col("root").alias("component"), "component_id")

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        rows = self.sizes.join(self.classes(), "node", "left")
        return rows.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_copies_removed(spark, docs: DataFrame, sf_dir: str, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (then the smallest hash of the text; one of repeated rows).

    Rows without shingles stay.
    """
    join = JaccardJoin(docs, n, num, den)
    rows = join.sizes.where("node is not null").join(join.classes().select("node", "component"), "node")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = rows.groupBy("component").agg(F.min(row).alias("best"), F.count("*").alias("n"))
    gone = rows.join(best.where("n > 1"), "component").where(row != F.col("best")).select("doc_id", "text_hash").distinct()
    gone = small(stored(gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))))
    kept = docs.withColumn("__text_hash", F.xxhash64("text"))
    kept = kept.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_anti")
    repeated = stored(join.sizes.where("node is not null").groupBy("doc_id", "text_hash").count().where("count > 1"))
    if not repeated.isEmpty():
        worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
        kept = kept.where(worded).dropDuplicates(["doc_id", "__text_hash"]).unionByName(kept.where(~worded))
    return kept.select(*docs.columns)


def op4_ngram_jaccard(spark, sf_dir):
    return JaccardJoin(table(spark, sf_dir, "documents"), 4, 85, 100).documents()


#: All pairs of documents that share a shingle, and the closure of their links: affordable only on small tables.
OP4_SQL = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least_other, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes z ON d.doc_id = z.doc_id LEFT JOIN (SELECT doc_id, min(other) AS least_other FROM reach GROUP BY doc_id) r ON d.doc_id = r.doc_id
"""
