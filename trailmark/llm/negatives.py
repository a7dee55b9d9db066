"""Hard-negative mining with candidate lists that the anchors of a cluster share.

1. Anchors are taken in blocks of at most about ``BLOCK`` components (a block is what is sent to the tasks); each block is clustered by direction. A
   cluster knows its centre and its spread, the largest angle between the centre and a member.
2. Candidates stay where they are. For a cluster, each candidate has an upper bound of its score with any member: its length times the
   cosine of its angle to the centre less the spread, times the member's length. A task sorts its candidates by that bound once a cluster.
3. Every member walks the sorted list from the top and stops where the bound falls below what could still enter its result: the last
   of its best so far or, for negatives, the lower end of the window. What a task has found holds for its later batches. Bounds are rounded up, scores are exact
   integers, so that the walk ends only where it is certain.
4. Positives come first; negatives are looked for in a second walk, with a window (80 to 100 hundredths of the positive's score) for
   each distinct score of an anchor's positives. Each task sends its best few of every anchor; Spark ranks these.

Work is what anchors times rows ask for, less what the bounds spare (little for directions without clusters, most for
tight ones); nothing but the few best of a task is shuffled, and the driver holds one block of anchors with their positives at a time.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows with a null vec_id, which can't be named. Of
rows that share a vec_id one counts, that of the smallest label, then vector. Vectors of different lengths are padded with zeros; an empty one
scores 0 with all. Products beyond 64 bits count as the largest such integer. A positive score below 0 has an empty window. An
anchor without others of its label has no rows; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, stored, table

#: Components of the anchors that one pass over the rows serves (8 bytes each; they are sent to every task).
BLOCK = 2_000_000
#: Candidates of a list that members walk at a time, and candidates that a task sorts together.
STRIDE, BATCH = 512, 16_384
#: Relative slack of a bound for rounding.
SLACK = 1e-9
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantized(df: DataFrame, relabel: int = 7) -> DataFrame:
    """vec_id, label, v (array of integers) of the rows that take part."""
    x = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    rows = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    label = F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.transform("x", lambda c: F.floor(c * 256)).alias("v"))
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return stored(rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as a matrix of 64-bit integers, padded with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = max(width, int(ends.max(initial=0)))
    out = np.zeros((len(ends), width), np.int64)
    out[np.arange(width) < ends[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of both, as 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = math.prod(max(abs(int(x.min())), abs(int(x.max()))) for x in (a, b)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most <= MOST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def _directions(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero for a zero vector) and lengths."""
    v = v.astype(np.float64)
    length = np.sqrt((v * v).sum(axis=1))
    return v / np.where(length > 0, length, 1)[:, None], length


class Best:
    """The ``k`` best (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.k, self.least = k, np.full(slots, LEAST)
        self.slot = self.score = self.id = np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = rank < self.k
        self.slot, self.score, self.id = slot[kept], score[order][kept], ids[order][kept]
        last = rank[kept] == self.k - 1
        self.least[self.slot[last]] = self.score[last]


class Anchors:
    """A block of anchors in clusters: (members, unit centre, spread) each, members as positions in the block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, rounds: int = 5):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        units, self.lengths = _directions(vectors)
        centres = units[np.random.default_rng(0).permutation(len(ids))[: math.ceil(math.sqrt(len(ids)))]]
        for _ in range(rounds):
            home = np.argmax(units @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, home, units)
            moved, length = _directions(sums)
            centres = np.where(length[:, None] > 0, moved, centres)
        home = np.argmax(units @ centres.T, axis=1)
        self.clusters = []
        for c in np.unique(home):
            members = np.flatnonzero(home == c)
            cosines = np.clip(units[members] @ centres[c], -1, 1)
            self.clusters.append((members, centres[c], float(np.arccos(cosines.min()))))

    def walk(self, cluster: int, vectors: np.ndarray, needs: Callable[[], np.ndarray], visit: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
        """Calls ``visit(members, candidates, scores)`` down the cluster's list; ``needs()``: the score that each member's next candidate must reach."""
        members, centre, spread = self.clusters[cluster]
        width = max(vectors.shape[1], self.vectors.shape[1])
        vectors, own, centre = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, self.vectors[members], centre[None]))
        units, length = _directions(vectors)
        angle = np.arccos(np.clip(units @ centre[0], -1, 1))
        bound = length * (np.cos(np.maximum(0, angle - spread - 1e-7)) + SLACK)
        order = np.argsort(-bound, kind="stable")
        for at in range(0, len(order), STRIDE):
            part = order[at : at + STRIDE]
            live = np.flatnonzero(self.lengths[members] * (bound[part[0]] + SLACK * length[part[0]]) >= needs().astype(np.float64) * (1 - SLACK) - 1)
            if not len(live):
                return
            visit(live, part, products(own[live], vectors[part]))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), matrix(part.column(2))


def _positives(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Anchors = sent.value
        best = [Best(len(members), k) for members, *_ in block.clusters]
        for ids, labels, vectors in _batches(batches):
            for c, (members, *_) in enumerate(block.clusters):
                top = best[c]

                def visit(live: np.ndarray, part: np.ndarray, scores: np.ndarray, members=members, top=top) -> None:
                    own = members[live]
                    fits = (labels[part] == block.labels[own][:, None]) & (ids[part] != block.ids[own][:, None]) & (scores >= top.least[live][:, None])
                    i, j = np.nonzero(fits)
                    if len(i):
                        top.add(live[i], scores[i, j], ids[part[j]])

                block.walk(c, vectors, lambda top=top: top.least, visit)
        for top, (members, *_) in zip(best, block.clusters, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[members[top.slot]]), pa.array(top.id), pa.array(top.score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(sent, k: int, low: int, high: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = sent.value  # asked: the distinct scores of each anchor's positives
        state = []
        for members, *_ in block.clusters:
            windows = [(i, p, -(-low * p // high), p) for i, m in enumerate(members) for p in asked.get(int(block.ids[m]), ()) if -(-low * p // high) <= p]
            owner, score, floor, roof = (np.array(x, np.int64) for x in zip(*windows, strict=True)) if windows else (np.zeros(0, np.int64),) * 4
            state.append((Best(len(owner), k), owner, score, floor, roof))
        for ids, labels, vectors in _batches(batches):
            for c, (members, *_) in enumerate(block.clusters):
                top, owner, _, floor, roof = state[c]

                def needs(n=len(members), top=top, owner=owner, floor=floor) -> np.ndarray:
                    out = np.full(n, MOST)
                    np.minimum.at(out, owner, np.maximum(floor, top.least))
                    return out

                def visit(live: np.ndarray, part: np.ndarray, scores: np.ndarray, members=members, top=top, owner=owner, floor=floor, roof=roof) -> None:
                    other = labels[part] != block.labels[members[live]][:, None]
                    row = np.full(len(members), -1)
                    row[live] = np.arange(len(live))
                    slots = np.flatnonzero(row[owner] >= 0)
                    least, s = np.maximum(floor, top.least)[slots], scores[row[owner[slots]]]
                    i, j = np.nonzero((s >= least[:, None]) & (s <= roof[slots][:, None]) & other[row[owner[slots]]])
                    if len(i):
                        top.add(slots[i], s[i, j], ids[part[j]])

                block.walk(c, vectors, needs, visit)
        for (top, owner, score, *_), (members, *_) in zip(state, block.clusters, strict=True):
            anchor = block.ids[members[owner[top.slot]]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor, score[top.slot], top.id, top.score)], ["anchor_id", "positive_score", "negative_id", "negative_score"])

    return run


def _ranked(df: DataFrame, keys: list[str], score: str, other: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), other))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. A negative's score is ``low`` to ``high`` hundredths of its positive's.
    """
    spark, rows = df.sparkSession, quantized(df)
    anchors = stored(rows.where(F.col("vec_id") % every == 0))
    components = anchors.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    passes = max(1, math.ceil(components / block))
    of = F.pmod(F.xxhash64("vec_id"), F.lit(passes))
    found: list[DataFrame] = []
    for i in range(passes):
        own = anchors.where(of == i).select("vec_id", "label", "v").toArrow().combine_chunks()
        if not own.num_rows:
            continue
        ids, labels = (own.column(c).to_numpy() for c in (0, 1))
        by = Anchors(ids, labels, matrix(own.column(2).combine_chunks()))
        sent = spark.sparkContext.broadcast(by)
        best = arrow_map(rows, _positives(sent, positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
        best = stored(_ranked(best, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"))
        asked: dict[int, set[int]] = {}
        for a, p in zip(*(c.to_pylist() for c in best.select("anchor_id", "positive_score").toArrow().columns), strict=True):
            asked.setdefault(a, set()).add(p)
        sent = spark.sparkContext.broadcast((by, asked))
        hard = arrow_map(rows, _negatives(sent, negatives, low, high), "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
        hard = _ranked(hard, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
        found.append(stored(best.join(hard, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")))
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, found) if found else empty


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
met AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 5
"""
