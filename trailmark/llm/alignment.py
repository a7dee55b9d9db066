"""Alignment of two tokenizers over a corpus, by byte ends, with diagonal run skipping.

1. Ends. Each text's tokens by A and by B become two increasing arrays of byte ends over the same bytes. Where both arrays have an end, a group ends.
2. Runs. At the current shift between the two indices the arrays are compared, the first ``LINEAR`` ends one by one, then in stretches of 8, 16, 32, ... ends; the
   first stretch that differs is halved down to where the run ends. So a one-to-one stretch of n tokens costs log n comparisons of slices.
3. An irregular group is walked token by token, always on the side that is behind, until both ends meet. The shift becomes what the two
   sides took, and the next run begins.
4. Counts. Tasks count the documents of each linked pair of ids before they are shuffled. The table of counts, as large as the pairs of both
   vocabularies that ever meet, goes to all tasks if it has at most ``SENT`` rows, and is joined with the documents' pairs by shuffle otherwise.

No token of either side runs over a single space that stands between two other characters: A's pattern parts there, and no piece of B has a space behind another
character (tested when the model is read; otherwise texts are taken whole). A text may therefore be cut there, and bounded memos keep the ids of
recent stretches, and whether both sides spell them unchanged: texts of such stretches alone are not spelled again. Ends, runs and groups are those of whole texts.

Defined results: null and empty texts, and those whose bytes either side changes, have no tokens: zeros and an empty digest. Repeated rows count as
documents of their own. A null doc_id stays null. An empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import dropped
from .common import arrow_map, stored, table

#: Stretches that each of two memos keeps, the longest one (in characters), and characters that are aligned at a time.
MEMO, MEMO_CHARS, CHARS = 500_000, 48, 1 << 20
#: Ends that are compared one by one before probes double.
LINEAR = 8
#: Rows of the table of counts (17 bytes each) that are sent to all tasks.
SENT = 3_000_000
#: Pairs that a task gathers before it sends their counts.
GATHERED = 4_000_000
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def aligned(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """How two increasing lists of byte ends with the same last one lie to each other, as two flat lists.

    Runs: first token of A, of B and length of each one-to-one stretch. Others: first token of A, of B and last token of A, of B of each irregular group.
    """
    runs: list[int] = []
    others: list[int] = []
    i, j, n = 0, 0, len(a)
    while i < n:
        run = 0
        while run < LINEAR and i + run < n and a[i + run] == b[j + run]:
            run += 1
        if run == LINEAR:
            step = LINEAR
            while i + run < n and (x := a[i + run : i + run + step]) == b[j + run : j + run + step]:
                run += len(x)
                step *= 2
            while step := step // 2:  # half of the probe that differs, and so on
                if i + run < n and (x := a[i + run : i + run + step]) == b[j + run : j + run + step]:
                    run += len(x)
        if run:
            runs += i, j, run
            i, j = i + run, j + run
            if i == n:
                break
        others += i, j
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        others += i, j
        i, j = i + 1, j + 1
    return runs, others


def byte_table(path: str) -> dict[int, bytes]:
    """Bytes of each entry of a byte-level vocabulary: printable characters stand for themselves, the other bytes, in order, for those from 256 on."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    known = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    return {i: bytes(byte_of[c] for c in entry) for entry, i in known.items() if all(c in byte_of for c in entry)}


class Entries:
    """A table of byte strings, concatenated by arrays of indices."""

    def __init__(self, entries: list[bytes]):
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, and the end of each entry in them."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.blob[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges of ``n`` integers from each ``first``, one after another."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Grown:
    """An array that takes more values at its end."""

    def __init__(self, dtype: type, first: tuple = ()):
        self.values, self.n = np.array(first, dtype), len(first)

    def extend(self, more: np.ndarray) -> None:
        if (n := self.n + len(more)) > len(self.values):
            self.values = np.concatenate((self.values[: self.n], np.empty(max(n, 1024), self.values.dtype)))
        self.values[self.n : n] = more
        self.n = n


class Stretches:
    """A memo: ids of A and of B of each stretch by its number, and whether the bytes of either are the stretch behind a space."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.ids, self.starts, self.kept = (Grown(np.int32), Grown(np.int32)), (Grown(np.int64, (0,)), Grown(np.int64, (0,))), Grown(bool)

    def add(self, stretches: list[str], ids: list[np.ndarray], lengths: list[np.ndarray], kept: np.ndarray) -> None:
        """``ids``, ``lengths``: all ids of A and of B, one stretch after another, and how many each has."""
        self.numbers.update(zip(stretches, range(len(self.numbers), len(self.numbers) + len(stretches)), strict=True))
        for side in range(2):
            self.starts[side].extend(np.cumsum(lengths[side]) + self.ids[side].n)
            self.ids[side].extend(ids[side])
        self.kept.extend(kept)

    def taken(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of one side of these stretches, one after another, and how many each has."""
        starts = self.starts[side].values
        first = starts[numbers]
        lengths = starts[numbers + 1] - first
        return self.ids[side].values[_ranges(first, lengths)], lengths

    def cut(self, stretches: list[str]) -> None:
        """Takes away the stretches that were added last."""
        for s in stretches:
            del self.numbers[s]
        self.kept.n = n = len(self.numbers)
        for side in range(2):
            self.starts[side].n, self.ids[side].n = n + 1, int(self.starts[side].values[n])


class Pair:
    """Both tokenizers, read in a task."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = SentencePieceProcessor(model_file=b_path)
        known = byte_table(a_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = Entries([known.get(i, b"") for i in range(max(known) + 1)])
        self.b_bytes = Entries([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        # up to seven decimals of each id in the low bytes of eight, for a separator in the last
        self.decimals = np.frombuffer(b"".join((b"%d" % i).ljust(8, b"\0") for i in range(max(max(known) + 1, len(pieces)))), "<u8")
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        self.new, self.old = Stretches(), Stretches()  # a full memo becomes the old one

    def numbered(self, stretches: list[str]) -> tuple[np.ndarray, list[str]]:
        """Number of each stretch in the new memo, and the stretches that are too long to stay there."""
        at = np.fromiter(map(self.new.numbers.get, stretches, repeat(-1)), np.int64, len(stretches))
        absent = np.flatnonzero(at < 0).tolist()
        missing = dict.fromkeys(map(stretches.__getitem__, absent))
        if self.new.numbers and len(self.new.numbers) + len(missing) > MEMO:
            self.old, self.new = self.new, Stretches()
            return self.numbered(stretches)
        known = [s for s in missing if s in self.old.numbers]
        if known:
            of = np.array(list(map(self.old.numbers.__getitem__, known)))
            ids, lengths = zip(*(self.old.taken(side, of) for side in range(2)), strict=True)
            self.new.add(known, ids, lengths, self.old.kept.values[of])
        fresh = [s for s in missing if s not in self.old.numbers]
        long = [s for s in fresh if len(s) > MEMO_CHARS]
        if fresh:
            self.encode([s for s in fresh if len(s) <= MEMO_CHARS] + long)
        at[absent] = [self.new.numbers[stretches[i]] for i in absent]
        return at, long

    def encode(self, stretches: list[str]) -> None:
        """Adds stretches to the new memo."""
        left = [x.ids for x in self.a.encode_batch_fast([" " + s for s in stretches], add_special_tokens=False)]
        right = self.b.encode(stretches, num_threads=1)
        lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
        ids = [np.fromiter(chain.from_iterable(x), np.int32, int(n.sum())) for x, n in zip((left, right), lengths, strict=True)]
        raw = [(" " + s).encode() for s in stretches]
        kept = np.ones(len(raw), bool)
        for entries, x, n in zip((self.a_bytes, self.b_bytes), ids, lengths, strict=True):
            spelled, ends = entries.join(x)
            spelled, ends = spelled.tobytes(), np.concatenate(([0], ends))[np.cumsum(n)].tolist()
            kept &= [spelled[i:j] == r for i, j, r in zip([0, *ends], ends, raw)]
        self.new.add(stretches, ids, lengths, kept)

    def documents(self, texts: list[str | None]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, distinct pairs and their numbers as bytes) of each text."""
        cut = [SINGLE_SPACE.split(t) if t and self.parted else [t] if t else [] for t in texts]
        numbers, long = self.numbered(list(chain.from_iterable(cut)))
        bounds = np.cumsum([0, *map(len, cut)])  # of each text's stretches
        upto = lambda n: np.concatenate(([0], np.cumsum(n)))[bounds].tolist()
        (a, n_a), (b, n_b) = (self.new.taken(side, numbers) for side in range(2))
        at_a, at_b, changed = upto(n_a), upto(n_b), upto(~self.new.kept.values[numbers])
        out = [self.document(t, a[at_a[i] : at_a[i + 1]], b[at_b[i] : at_b[i + 1]], changed[i] == changed[i + 1]) for i, t in enumerate(texts)]
        self.new.cut(long)
        return out

    def document(self, text: str | None, a: np.ndarray, b: np.ndarray, kept: bool) -> tuple:
        """``kept``: both sides spell each stretch unchanged, and so the text."""
        none = 0, 0, 0, 0, "", b"", b""
        if not text:
            return none
        if not kept:
            raw = (" " + text).encode()
            if any(entries.join(ids)[0].tobytes() != raw for entries, ids in ((self.a_bytes, a), (self.b_bytes, b))):
                return none
        a_ends, b_ends = np.cumsum(self.a_bytes.lengths[a]), np.cumsum(self.b_bytes.lengths[b])
        runs, others = aligned(a_ends.tolist(), b_ends.tolist())
        i, j, n = np.array(runs, np.int64).reshape(-1, 3).T
        i, j = _ranges(i, n), _ranges(j, n)
        p, q, last_p, last_q = np.array(others, np.int64).reshape(-1, 4).T
        last_a, last_b = np.sort(np.concatenate((i, last_p))), np.sort(np.concatenate((j, last_q)))
        # tokens of an irregular group overlap once in each stretch between two ends of either side
        stops = np.sort(np.concatenate((a_ends[_ranges(p, last_p - p + 1)], b_ends[_ranges(q, last_q - q + 1)])))
        stops = stops[np.diff(stops, prepend=-1) > 0]
        i, j = np.concatenate((i, np.searchsorted(a_ends, stops))), np.concatenate((j, np.searchsorted(b_ends, stops)))
        pairs, times = np.unique(a[i] * np.int64(len(self.b_bytes.lengths)) + b[j], return_counts=True)
        return len(a), len(b), len(last_a), len(i), self.digest(a, b, last_a, last_b), pairs.tobytes(), times.astype(np.int32).tobytes()

    def digest(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> str:
        """SHA-256 of the groups as text; ``last_a`` and ``last_b``: each group's last token."""
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        at_a = np.arange(len(a)) + np.repeat(last_b + 1 - n_b, n_a)  # behind B's tokens of earlier groups
        at_b = np.arange(len(b)) + np.repeat(last_a + 1, n_b)
        ids = np.empty(len(a) + len(b), np.int64)
        ids[at_a], ids[at_b] = a, b
        behind = np.full(len(ids), ord(","), "<u8")
        behind[at_a[last_a]], behind[at_b[last_b]] = ord("|"), ord(";")
        said = (self.decimals[ids] | behind << np.uint64(56)).view(np.uint8)
        return hashlib.sha256(said[said > 0][:-1].tobytes()).hexdigest()


@lru_cache(1)
def _pair(a_path: str, b_path: str) -> Pair:
    """The tokenizers and memos of a worker, which its tasks share."""
    return Pair(a_path, b_path)


_FIELDS = [
    ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())
]


def _alignments(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _pair(a_path, b_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            chars = np.cumsum([len(t or "") for t in texts])
            at = 0
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + CHARS, "right")))
                rows = both.documents(texts[at:end])
                columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_FIELDS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *columns], ["doc_id", *(n for n, _ in _FIELDS)])
                at = end

    return run


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n: documents of each pair, one row a pair and ``GATHERED`` pairs or less."""
    held: list[np.ndarray] = []
    for batch in batches:
        for x in batch.column(0):
            held.append(np.frombuffer(x.as_py(), np.int64))
        if sum(map(len, held)) >= GATHERED:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(held), return_counts=True)], ["pair", "n"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate(held), return_counts=True)], ["pair", "n"])


def _looked_up(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            found = []
            for p, t in zip(batch.column(0), batch.column(1), strict=True):
                at, times = np.searchsorted(pairs, np.frombuffer(p.as_py(), np.int64)), np.frombuffer(t.as_py(), np.int32).astype(np.int64)
                found.append((int(times[best[at]].sum()), int((times * n[at]).sum())))
            columns = [pa.array([r[i] for r in found], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], [*batch.schema.names[2:], "n_best", "count_sum"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, pair, times: a row a document's distinct pair."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            pairs = [np.frombuffer(x.as_py(), np.int64) for x in part.column(1)]
            times = [np.frombuffer(x.as_py(), np.int32) for x in part.column(2)]
            rows = np.repeat(part.column(0).to_numpy(), list(map(len, pairs)))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times).astype(np.int64))], ["row", "pair", "times"])


class Alignments:
    """Every document's alignment and the corpus-wide counts of linked pairs."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text"):
        from sentencepiece import SentencePieceProcessor

        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
        #: a row a document; pairs (id of A times size of B plus id of B) and times (of each pair) as bytes; row: a key
        self.rows = stored(arrow_map(texts, _alignments(a_path, b_path), schema).withColumn("row", F.monotonically_increasing_id()))
        counts = arrow_map(self.rows.select("pairs"), _numbers, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        counts = stored(counts.withColumn("a", F.expr(f"pair div {SentencePieceProcessor(model_file=b_path).get_piece_size()}")))
        highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # at most one row an entry of A
        #: pair, n (documents that hold it), best (whether n is its A id's highest)
        self.counts = stored(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))
        dropped(counts)

    def documents(self, sent: int = SENT) -> DataFrame:
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
        if self.counts.count() <= sent:
            known = self.counts.toArrow()
            pairs, n, best = (known.column(c).to_numpy() for c in ("pair", "n", "best"))
            order = np.argsort(pairs)
            given = self.rows.sparkSession.sparkContext.broadcast((pairs[order], n[order], best[order]))
            schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
            out = arrow_map(self.rows.select("pairs", "times", *names), _looked_up(given), schema)
        else:
            spread = arrow_map(self.rows.select("row", "pairs", "times"), _spread, "row bigint, pair bigint, times bigint").join(self.counts, "pair")
            sums = spread.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
            out = self.rows.join(sums, "row", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})
        return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_cross_alignment(spark, sf_dir):
    import public_tokenizers

    return Alignments(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).documents()
