"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary resolves a whole pre-token that is a vocabulary entry.
Tier 2: on a miss, a heap of adjacent pairs over a linked list of bytes applies the merges by rank.
Memos of bounded size keep what the two tiers returned for recent pre-tokens, and for stretches between single spaces:
no match of the pattern runs over a single space that stands between two other characters, so a text may be cut there.

Defined results: a null text is the empty text, which has no token and decodes to no byte; a very long pre-token
costs O(n log n); texts are mapped one by one, so repeated rows give equal values and an empty table an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import per_row

#: Entries of each memo, and the longest key (in characters) that it keeps.
MEMO, MEMO_CHARS = 600_000, 48
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in the order of their ranks (bounded: one vocabulary)."""
    with open(path, "rb") as f:
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f) if a)
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must run from 0 without gaps")
    return [t for _, t in pairs]


class PerfectHash:
    """Minimal perfect hash by displacement: as many slots as keys. ``seeds[b]`` >= 0 is the second seed of bucket b;
    a negative one names the slot itself."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        digest = xxhash.xxh3_64_intdigest
        buckets: list[list[int]] = [[] for _ in range(n)]
        for i, k in enumerate(keys):
            buckets[digest(k) % n].append(i)
        self.seeds, self.ids, self.keys = [0] * n, [-1] * n, [b""] * n
        order = sorted((b for b in range(n) if buckets[b]), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            own = buckets[b]
            if len(own) > 1:
                seed = 1
                while len(slots := {digest(keys[i], seed) % n for i in own}) < len(own) or any(self.ids[s] >= 0 for s in slots):
                    seed += 1
                at = [digest(keys[i], seed) % n for i in own]
                self.seeds[b] = seed
            else:
                free = free or iter([s for s in range(n) if self.ids[s] < 0])
                at = [next(free)]
                self.seeds[b] = -at[0] - 1
            for i, s in zip(own, at, strict=True):
                self.ids[s], self.keys[s] = i, keys[i]

    def get(self, key: bytes) -> int:
        """The key's rank, or -1."""
        seed = self.seeds[xxhash.xxh3_64_intdigest(key) % self.n]
        slot = -seed - 1 if seed < 0 else xxhash.xxh3_64_intdigest(key, seed) % self.n
        return self.ids[slot] if self.keys[slot] == key else -1


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest rank first, leftmost on ties: a heap of adjacent pairs over linked parts, each entry (rank, start, end) in one integer."""
    n = len(token)
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    heap = [r << 64 | i << 32 | i + 2 for i in range(n - 1) if (r := get(token[i : i + 2])) is not None]
    if not heap:
        return [ranks[token[i : i + 1]] for i in range(n)]
    heapq.heapify(heap)
    after, before = list(range(1, n + 2)), list(range(-1, n + 1))  # links between starts of parts; a merged start links to 0
    while heap:
        x = pop(heap)
        end, i = x & 0xFFFFFFFF, x >> 32 & 0xFFFFFFFF
        j = after[i]
        if not j or j >= n or after[j] != end:
            continue  # one of its parts has been merged meanwhile
        after[j] = 0
        after[i] = end
        before[end] = i
        if end < n and (r := get(token[i : after[end]])) is not None:
            push(heap, r << 64 | i << 32 | after[end])
        if i and (r := get(token[before[i] : end])) is not None:
            push(heap, r << 64 | before[i] << 32 | end)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class Spelling:
    """Concatenates the entries of a table of byte strings by an array of indices."""

    def __init__(self, entries: list[bytes]):
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        shift = self.starts[ids] - ends + n
        return self.blob[np.repeat(shift, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Memo(dict):
    """Key -> ids as bytes of int32, filled on demand by ``fill`` and emptied when full."""

    def __init__(self, fill, size: int = MEMO):
        super().__init__()
        self.fill, self.size = fill, size

    def __missing__(self, key: str) -> bytes:
        ids = self.fill(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.size:
                self.clear()
            self[key] = ids
        return ids


class Codec:
    def __init__(self, entries: list[bytes], pattern: str, hashed: PerfectHash, memo: int = MEMO):
        self.hashed, self.split = hashed, regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(entries)}  # pairs, for the second tier
        self.bytes = Spelling(entries)
        self.decimals = Spelling([b"%d " % i for i in range(len(entries))])
        self.tokens = Memo(self.lookup, memo)
        self.stretches = Memo(lambda s: b"".join(map(self.tokens.__getitem__, self.split(" " + s))), memo)

    def lookup(self, token: str) -> bytes:
        """The two tiers."""
        raw = token.encode()
        i = self.hashed.get(raw)
        return array("i", (i,) if i >= 0 else merge(raw, self.ranks)).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        first, *others = SINGLE_SPACE.split(text or "")
        parts = [*map(self.tokens.__getitem__, self.split(first)), *map(self.stretches.__getitem__, others)]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.bytes.join(ids)


def _codec(spark, path: str, pattern: str, memo: int = MEMO):
    """A function that gives each task the codec; the hash is built once here and broadcast (size of one vocabulary)."""
    entries = read_ranks(path)
    sent = spark.sparkContext.broadcast((entries, PerfectHash(entries)))
    return lambda: Codec(sent.value[0], pattern, sent.value[1], memo)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the column ``ids``: array of token ids of every whole text."""
    fn = lambda codec, t: (codec.encode(t),)
    return per_row(docs, text, fn, [("ids", pa.list_(pa.int32()), "array<int>")], list(keep), _codec(docs.sparkSession, path, pattern))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the column ``decoded``: the bytes that the ids stand for (null ids: none)."""
    fn = lambda codec, x: (codec.decode(np.array(x or [], np.int32)),)
    return per_row(tokens, ids, fn, [("decoded", pa.binary(), "binary")], list(keep), _codec(tokens.sparkSession, path, pattern))


def _digest(codec: Codec, text: str | None) -> tuple:
    """In pieces of 2^18 ids, so that a very long text needs little memory beside its ids."""
    ids, decimal, raw = codec.encode(text), hashlib.sha256(), hashlib.sha256()
    for at in range(0, len(ids), 1 << 18):
        part = ids[at : at + (1 << 18)]
        decimal.update(codec.decimals.join(part)[: None if at + (1 << 18) < len(ids) else -1])  # no space after the last
        raw.update(codec.decode(part))
    return len(ids), decimal.hexdigest(), raw.hexdigest()


def token_digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), memo: int = MEMO) -> DataFrame:
    """Encodes, then decodes, every whole text; returns the number of tokens and digests of ids and decoded bytes. ``memo``: entries of each memo."""
    fields = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return per_row(docs, text, _digest, fields, list(keep), _codec(docs.sparkSession, path, pattern, memo))


def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from .common import table

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
