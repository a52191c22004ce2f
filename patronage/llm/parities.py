"""Parity bits of sets: a lower bound of how many elements differ, for a fraction of the sets' size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Least logarithm of the parity bits of a set.
LEAST_CELLS = 9


def parity_bits(tokens: np.ndarray) -> bytes:
    """A bit for each cell that an odd number of shingles falls into, two cells or more per shingle."""
    cells = 1 << max(LEAST_CELLS, (2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def differences(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Least number of shingles in which the set with parity bits ``x`` differs from those of ``rows``.

    A cell whose parity differs holds a shingle of one set only. Longer bits are folded."""
    while len(x) > rows.shape[1]:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while rows.shape[1] > len(x):
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return np.bitwise_count(rows ^ x).sum(axis=1, dtype=np.int64)


class Parities:
    """Sizes and parity bits of some sets."""

    def __init__(self, n: np.ndarray, bits: pa.Array):
        self.n = n
        self.rows = [np.frombuffer(value, np.uint8) for value in bits.to_pylist()]
        self.length = np.array([len(row) for row in self.rows])

    def may_link(self, i: int, others: np.ndarray) -> np.ndarray:
        """Whether the bits allow a similarity of 0.8: such sets share 4 / 9 of their sizes' sum or more."""
        out = np.zeros(len(others), bool)
        for length in np.unique(self.length[others]):
            at = np.flatnonzero(self.length[others] == length)
            both = self.n[i] + self.n[others[at]]
            out[at] = differences(self.rows[i], np.stack([self.rows[k] for k in others[at]])) <= both - 2 * -(-4 * both // 9)
        return out
