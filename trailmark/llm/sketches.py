"""Odd sketches: bitmaps of parities. What two sets share cancels in their XOR, whose population count never exceeds the number of elements in one set only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 1024

_M = [np.uint64(m) for m in (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93)]


def odd_sketch(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of the positions of a set of 64-bit hashes, as 64-bit words."""
    h = values * _M[0]
    h = (h ^ (h >> np.uint64(33))) * _M[1]
    at = ((h ^ (h >> np.uint64(29))) * _M[2]) % np.uint64(bits)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def differing(a: str, b: str, bits: int = BITS) -> Column:
    """Population count of the XOR of two sketch columns."""
    counts = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(bits // 64)]
    return sum(counts[1:], counts[0])


def most_differing(a: Column, b: Column, num: int, den: int) -> Column:
    """The most elements in one set only that two sets of ``a`` and ``b`` elements have at a Jaccard similarity of ``num`` / ``den``."""
    return F.floor((a + b) * (den - num) / (den + num))
