"""Keys of documents, packed for a shuffle into buckets: a few bytes a key, hot keys combined before they move."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Keys in a bucket, about (a bucket's rows are one task's memory: some 50 bytes a key while it is sorted), and documents whose keys are combined before they move.
BUCKET, CHUNK = 2_000_000, 4096
SLOTS = "slot bigint, bucket bigint, nodes binary, counts binary, keys binary"
_SCHEMA = pa.schema([("slot", pa.int64()), ("bucket", pa.int64()), ("nodes", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_KEY = np.uint64((1 << 30) - 1)


def buckets_for(keys: int) -> int:
    return max(32, keys // BUCKET)


def bucketed(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 30 bits of each 64-bit hash, as one integer: what the packed form tells apart."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) << np.uint64(30) | hashes & _KEY


def packed(nodes: np.ndarray, counts: np.ndarray, hashes: np.ndarray, buckets: int, followers: bool, marks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A chunk's keys by bucket: the bucket's nodes, their numbers of keys, and the keys with two flags each.

    ``hashes``: ``counts`` of them for each of the ``nodes`` in turn. A key leaves a chunk once, by the first node that has it, with the flags
    "another node of the chunk has it" and "one of its ``marks`` is set". With ``followers`` the other nodes that have it go to slots of
    their own (negative ones, dealt by node), so a key that all documents have fills no bucket.
    """
    owner = np.repeat(np.arange(len(nodes)), counts)
    whole = bucketed(hashes, buckets)
    order = np.argsort(whole, kind="stable")
    whole, owner = whole[order], owner[order]
    once = np.flatnonzero(np.concatenate(([True], (whole[1:] != whole[:-1]) | (owner[1:] != owner[:-1]))))
    mark = np.zeros(len(once), bool) if marks is None else np.logical_or.reduceat(marks[order], once)
    whole, owner = whole[once], owner[once]
    new = np.concatenate(([True], whole[1:] != whole[:-1]))
    shared = ~new | np.append(~new[1:], False)
    if marks is not None:
        starts = np.flatnonzero(new)
        mark = np.repeat(np.logical_or.reduceat(mark, starts), np.diff(np.append(starts, len(new))))
    for leads in (True, False) if followers else (True,):
        chosen = np.flatnonzero(new == leads)
        if not len(chosen):
            continue
        b = whole[chosen] >> np.uint64(30)
        by = np.lexsort((owner[chosen], b))
        chosen, b = chosen[by], b[by]
        of = owner[chosen]
        low = ((whole[chosen] & _KEY) << np.uint64(2) | mark[chosen].astype(np.uint64) << np.uint64(1) | shared[chosen]).astype(np.uint32)
        edges = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        rows: list[tuple] = []
        for i, j in zip(edges, [*edges[1:], len(b)], strict=True):
            first = np.flatnonzero(np.concatenate(([True], of[i + 1 : j] != of[i : j - 1])))
            slot = int(b[i]) if leads else -1 - int(nodes[of[i]] & 0xFFFF)
            rows.append((slot, int(b[i]), nodes[of[i:j][first]].tobytes(), np.diff(np.append(first, j - i)).astype(np.uint32).tobytes(), low[i:j].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, keys as ``bucketed`` gives them, shared flags, marks) of one slot's rows, by key."""
    nodes, keys = [], []
    for bucket, n, c, k in zip(*(rows.column(i) for i in range(1, 5)), strict=True):
        nodes.append(np.repeat(np.frombuffer(n.as_py(), np.int64), np.frombuffer(c.as_py(), np.uint32)))
        keys.append(np.frombuffer(k.as_py(), np.uint32).astype(np.int64) | bucket.as_py() << 32)
    node, key = np.concatenate(nodes), np.concatenate(keys)
    order = np.argsort(key >> 2, kind="stable")
    node, key = node[order], key[order]
    return node, key >> 2, key & 1 > 0, key & 2 > 0


def pairs_of_shared(rows: pa.Table, marked: bool) -> tuple[np.ndarray, np.ndarray]:
    """(keys, nodes), each pair once, of one slot's keys that two and more nodes have (and that have a mark, if ``marked``); all of a slot of followers."""
    node, key, flag, mark = unpacked(rows)
    if rows.column(0)[0].as_py() >= 0:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        several = (np.minimum.reduceat(node, start) < np.maximum.reduceat(node, start)) | np.logical_or.reduceat(flag, start)
        if marked:
            several &= np.logical_or.reduceat(mark, start)
        several = np.repeat(several, np.diff(np.append(start, len(key))))
        node, key = node[several], key[several]
    order = np.lexsort((node, key))
    node, key = node[order], key[order]
    once = np.concatenate(([True], (node[1:] != node[:-1]) | (key[1:] != key[:-1])))[: len(node)]
    return key[once], node[once]
