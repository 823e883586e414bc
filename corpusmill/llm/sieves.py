"""Sieves of a bounded number of bits: which 64-bit names may be in a table. A full sieve lets all names pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve, at most.
BITS = 1 << 28


def sieve(names: DataFrame) -> np.ndarray:
    """Two bits of each of the column ``name``'s values: eight to sixteen bits a row, and ``BITS`` at most."""
    size = min(BITS, 1 << max(15, (8 * names.count()).bit_length()))
    bits = F.array(*(F.shiftright("name", s).bitwiseAND(size - 1) + 1 for s in (0, 32)))  # Spark's buckets start with 1
    bit = names.select(F.explode(bits).alias("bit"))
    rows = bit.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toArrow()
    out = np.zeros((size >> 15, 4096), np.uint8)
    for k, b in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist()):
        out[k - 1] = np.frombuffer(b, np.uint8)
    return out.reshape(-1)


def passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether names may be in the sieve's table."""
    out, mask = np.ones(len(names), bool), 8 * len(bits) - 1
    for s in (0, 32):
        at = (names >> s) & mask
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


class Places:
    """Places of names in an array of different names, by a table with open addresses."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.mask = (1 << max(4, (2 * len(names)).bit_length())) - 1
        self.table = np.full(self.mask + 1, -1, np.int32)
        left, step = np.arange(len(names), dtype=np.int32), 0
        while len(left):
            at = (names[left] + step) & self.mask
            free = self.table[at] < 0
            self.table[at[free]] = left[free]
            left, step = left[self.table[at] != left], step + 1

    def find(self, names: np.ndarray) -> np.ndarray:
        """The place of each name, -1 where it is absent."""
        out = np.full(len(names), -1, np.int64)
        left, step = np.arange(len(names)), 0
        while len(left):
            place = self.table[(names[left] + step) & self.mask]
            some = place >= 0
            left, place = left[some], place[some]
            hit = self.names[place] == names[left]
            out[left[hit]] = place[hit]
            left, step = left[~hit], step + 1
        return out
