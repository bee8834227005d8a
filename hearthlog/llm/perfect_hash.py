"""Minimal perfect hashing of distinct integers: bit levels in which every key has a place of its own.

A key belongs to the first level at which no other key left shares its bit. Its
index is the number of bits set before its own, so n keys have the indices 0 to
n - 1. About 3.5 bits a key. A number that was not hashed may get any index, so
look-ups compare the key that is kept there.
"""
from __future__ import annotations

import numpy as np

# places for a key left at a level
ROOM = 2


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of each key (splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        """`sizes` are the levels' words of 64 bits, `bits` all their words."""
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)))

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct `keys`; none give a hash without indices."""
        sizes, levels, left = [], [], keys
        while len(left):
            words = -(-ROOM * len(left) // 64)
            place = (mixed(left, len(sizes)) % np.uint64(64 * words)).astype(np.int64)
            alone = np.bincount(place, minlength=64 * words) == 1
            sizes.append(words)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Indices of `keys`, -1 for those that no level holds."""
        out, first = np.full(len(keys), -1, np.int64), 0
        open_ones = np.arange(len(keys))
        for level, words in enumerate(self.sizes.tolist()):
            place = mixed(keys[open_ones], level) % np.uint64(64 * words)
            word, bit = first + (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            held = self.bits[word]
            hit = (held >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_ones[hit]] = (self.before[word] + below)[hit]
            open_ones, first = open_ones[~hit], first + words
        return out
