"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-case words, hashed to ``DIM`` columns. A document's score is
sigmoid(bias + sum of weights + sum over pairs of terms of the inner product of their factors), so pairs such as an
insult with a group's name count beyond what each adds alone. Texts are cut into segments of ``SEGMENT`` words; the terms
of a segment are its features, and a document's logit is that of its highest segment, so that an insult weighs the same in a short
and in a very long text.

Training: labelled rows outside the held-out fold, with all their segments, go to the driver as term numbers; a model of
fixed size comes back by broadcast. The sample has two documented bounds: ``max_rows`` rows (those with the lowest hash of doc_id), and of these
as many, in the order of the hash, as have ``max_chars`` characters together (a row of over a hundredth of that is left out of the sample). Terms get a weight and factors if their presence goes with the label beyond chance (a log-likelihood ratio of at least
``MIN_RATIO`` over the training rows), or if it does among the segments with some other term (``PAIR_RATIO``, as there are far more pairs than
terms; ``PAIR_ROWS`` segments at least), so that a pair counts whose terms are neutral alone. The rest can't be told from noise in the labels. Scoring reads
every whole text.

Labels, lang, source and doc_id never enter a score. Null and empty texts are one segment without terms: they score the bias.
Several labels of one doc_id: the highest counts. Null doc_ids have no label and are in the fold that crc32 of the empty
text gives. Repeated rows score alike; an empty table gives an empty table; without a labelled row every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..arrow import released
from .common import per_row, table

DIM, FACTORS, SEGMENT, MIN_RATIO, PAIR_ROWS, PAIR_RATIO = 1 << 18, 4, 400, 16.0, 8, 40.0
#: Rows whose terms are laid out flat at a time.
BLOCK = 512
TERM = re.compile(r"[^\W_]+")


def segments(text: str | None, size: int = SEGMENT) -> list[np.ndarray]:
    """Distinct hashed terms of each stretch of ``size`` words; the last two stretches overlap rather than leave a short one."""
    words = TERM.findall((text or "").lower())
    starts = list(range(0, max(len(words) - size, 0) + 1, size))
    if starts[-1] + size < len(words):
        starts.append(len(words) - size)
    digest = xxhash.xxh3_64_intdigest
    return [np.fromiter({digest(w) & DIM - 1 for w in set(words[a : a + size])}, np.int64) for a in starts]


class Machine:
    """Bias, weights and factors; a row of terms scores in time linear in terms and factors."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = bias, weights, factors

    def logit(self, terms: np.ndarray) -> float:
        v = self.factors[terms]
        total = v.sum(0)
        return float(self.bias + self.weights[terms].sum() + 0.5 * (total @ total - np.einsum("ij,ij->", v, v)))

    def score(self, text: str | None) -> float:
        z = max(map(self.logit, segments(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_ratio(both: np.ndarray, with_term: np.ndarray, total: float, n: float) -> np.ndarray:
    """Log-likelihood ratio of presence and label: toxic rows with each term, rows with it, toxic rows, rows."""
    ratio = np.zeros(len(both))
    for k, row, column in ((both, with_term, total), (with_term - both, with_term, n - total), (total - both, n - with_term, total), (n - total - with_term + both, n - with_term, n - total)):
        ratio += 2 * k * np.log(np.maximum(k, 1e-9) * n / np.maximum(row * column, 1e-9))
    return ratio


def flat(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms and their rows' numbers, a block of rows at a time."""
    for at in range(0, len(rows), BLOCK):
        part = rows[at : at + BLOCK]
        yield np.concatenate(part), np.repeat(np.arange(at, at + len(part), dtype=np.int32), [len(r) for r in part])


def informative(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which terms' log-likelihood ratio (of presence and label) reaches ``MIN_RATIO``."""
    both, with_term = np.zeros(DIM), np.zeros(DIM)
    for terms, of in flat(rows):
        both += np.bincount(terms, labels[of], DIM)
        with_term += np.bincount(terms, minlength=DIM)
    return label_ratio(both, with_term, labels.sum(), len(rows)) >= MIN_RATIO


def holders_of(rows: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Which rows hold each of ``n`` terms, in order; a row holds a term once."""
    counts = np.zeros(n, np.int64)
    for terms, _ in flat(rows):
        counts += np.bincount(terms, minlength=n)
    starts = np.cumsum(counts) - counts
    held, free = np.empty(int(counts.sum()), np.int32), starts.copy()
    for terms, of in flat(rows):
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        held[free[terms] + np.arange(len(terms)) - np.searchsorted(terms, terms)] = of[order]
        free += np.bincount(terms, minlength=n)
    return np.split(held, starts[1:])


def interacting(segs: list[np.ndarray], labels: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Which terms belong to a pair: one that isn't ``strong`` goes with the label among the segments with the other."""
    often = sum((np.bincount(terms, minlength=DIM) for terms, _ in flat(segs)), np.zeros(DIM, np.int64)) >= PAIR_ROWS
    ids = np.flatnonzero(often)
    place = (np.cumsum(often) - 1).astype(np.int32)
    rows = [place[s[often[s]]] for s in segs]
    holders = holders_of(rows, len(ids))
    free, paired = ~strong[ids], np.zeros(len(ids), bool)
    for a, held in enumerate(holders):
        y = labels[held]
        if not len(held) or not 0 < y.sum() < len(y):
            continue
        n, both = np.zeros(len(ids)), np.zeros(len(ids))
        for at in range(0, len(held), 1024):  # a common term's segments take no more memory than a block of them
            part = [rows[i] for i in held[at : at + 1024]]
            beside = np.concatenate(part)
            n += np.bincount(beside, minlength=len(ids))
            both += np.bincount(beside, np.repeat(y[at : at + 1024], [len(r) for r in part]), len(ids))
        some = np.flatnonzero(free & (n >= PAIR_ROWS) & (n < len(held)))
        found = some[label_ratio(both[some], n[some], y.sum(), len(held)) >= PAIR_RATIO]
        if len(found):
            paired[found] = paired[a] = True
    out = np.zeros(DIM, bool)
    out[ids[paired]] = True
    return out


def fit(rows: list[list[np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Adagrad over mini-batches. Each row trains on the segment that scores highest at the start of an epoch."""
    bias, weights = 0.0, np.zeros(DIM, np.float32)
    rng = np.random.default_rng(seed)
    factors = np.zeros((DIM, FACTORS), np.float32)
    if not len(rows) or labels.min() == labels.max():
        p = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(rows) else 1e-13
        return Machine(float(np.log(p / (1 - p))), weights, factors)
    used = informative([np.unique(np.concatenate(segs)) for segs in rows], labels)
    used |= interacting([s for segs in rows for s in segs], np.repeat(labels, [len(segs) for segs in rows]), used)
    factors[used] = rng.normal(0, 0.05, (int(used.sum()), FACTORS))
    rows = [[s[used[s]] for s in segs] for segs in rows]
    gw, gv, gb = np.full(DIM, 1e-2, np.float32), np.full((DIM, FACTORS), 1e-2, np.float32), 1.0
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    for _ in range(epochs):
        model = Machine(bias, weights, factors)
        picked = [segs[0] if len(segs) == 1 else max(segs, key=model.logit) for segs in rows]
        for at in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            sizes = np.array([len(picked[i]) for i in at])
            terms = np.concatenate([picked[i] for i in at]) if sizes.sum() else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(at)), sizes)
            v = factors[terms]
            total = np.zeros((len(at), FACTORS), np.float32)
            np.add.at(total, row, v)
            squares = np.bincount(row, (v * v).sum(1), len(at))
            z = bias + np.bincount(row, weights[terms], len(at)) + 0.5 * ((total * total).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]).astype(np.float32)
            ids, inverse = np.unique(terms, return_inverse=True)
            step_w = np.bincount(inverse, error[row], len(ids)).astype(np.float32) / 8 + decay * weights[ids]
            step_v = np.zeros((len(ids), FACTORS), np.float32)
            np.add.at(step_v, inverse, error[row][:, None] * (total[row] - v))
            step_v = step_v / 8 + decay * factors[ids]
            step_b = float(error.sum()) / 8
            gw[ids] += step_w**2
            gv[ids] += step_v**2
            gb += step_b**2
            weights[ids] -= rate * step_w / np.sqrt(gw[ids])
            factors[ids] -= rate * 0.5 * step_v / np.sqrt(gv[ids])
            bias -= rate * step_b / gb**0.5
    return Machine(bias, weights, factors)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> DataFrame:
    """doc_id, text, label of the sample: at most ``max_rows`` labelled documents of ``max_chars`` characters together, those with the lowest hash of doc_id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg(F.max(label).alias("__label"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    same = F.col("doc_id") == F.col("__id")
    sizes = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("__n")).join(F.broadcast(chosen), same).groupBy("__id", "__label").agg(F.sum("__n").alias("__n"))
    before = F.sum("__n").over(Window.orderBy(F.xxhash64("__id"), "__id").rowsBetween(Window.unboundedPreceding, 0))  # over max_rows rows at most
    chosen = sizes.where(F.col("__n") <= max_chars // 100).withColumn("__sum", before).where(F.col("__sum") <= max_chars).select("__id", "__label")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), same).select("doc_id", "text", "__label")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 12_000, max_chars: int = 100_000_000) -> Machine:
    """``labels``: doc_id and the label. What comes to the driver are the term numbers of at most ``max_rows`` whole texts of ``max_chars`` characters together."""
    def pick(text: str | None) -> tuple:
        segs = sorted(segments(text), key=lambda s: xxhash.xxh3_64_intdigest(np.sort(s).tobytes()))
        return ([s.astype(np.int32) for s in segs],)

    rows = per_row(training_rows(docs, labels, label, max_rows, max_chars), "text", pick, [("segments", pa.list_(pa.list_(pa.int32())), "array<array<int>>")], ["doc_id", "__label"])
    got = rows.toArrow()
    ids, y = got.column("doc_id").to_numpy(), got.column("__label").to_numpy()
    order = np.argsort(ids, kind="stable")  # so that the fit does not depend on the order in which tasks end
    nested = got.column("segments")
    data = [[x.values.to_numpy(zero_copy_only=False).astype(np.int32) for x in nested[int(i)]] for i in order]
    del got, nested
    return fit(data, (y[order] > 0).astype(np.float64))


def scored(docs: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), column: str = "score") -> DataFrame:
    """``keep`` and the column ``score`` (or another name) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights, machine.factors))
    return per_row(docs, "text", lambda m, t: (m.score(t),), [(column, pa.float64(), "double")], list(keep), lambda: Machine(*sent.value))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitted(spark, docs: DataFrame, sf_dir: str) -> Machine:
    """A machine trained on the labels outside the held-out fold; the driver's memory that the sample took goes back to the system."""
    machine = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out()))
    released()
    return machine


def toxic_removed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score under 0.5, all columns."""
    return scored(docs, fitted(spark, docs, sf_dir), tuple(docs.columns), "__score").where("__score < 0.5").select(*docs.columns)


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(spark, docs, sf_dir)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
