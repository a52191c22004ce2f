"""Hashed lookup of what two adjacent symbols merge into, for whole arrays at once."""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing with linear probing, at most one third full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(3 * len(left) + 1))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key = self._key(left, right)
        slot, waiting = self._slot(key), np.arange(len(key))
        while len(waiting):
            at = slot[waiting]
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]] = key[waiting[placed]]
            self.values[at[placed]] = value[waiting[placed]]
            waiting = np.delete(waiting, placed)
            slot[waiting] = (slot[waiting] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Value of each pair, NONE where the pair does not merge. Symbols below 0 never do."""
        key = self._key(left, right)
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], NONE)
        open_ = np.flatnonzero((found != key) & (found != -1) & (key != -2))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out
