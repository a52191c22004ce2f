"""Word and shingle hashes of whole batches of texts, computed on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from patronage.llm.common import SLICE_BYTES, mix64, slices

SHINGLE_WORDS = 5
#: Text hashed at once; its arrays take some fifty times as much.
RUN_BYTES = SLICE_BYTES // 2
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: list[np.ndarray] = [np.array([], np.uint64)] * 2


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        inverse = pow(int(_BASE), -1, 2**64)
        for k, base in enumerate((_BASE, np.uint64(inverse))):
            factors = np.full(n + n // 4 + 1, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _word_hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where it starts. ``firsts``: where texts start."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[firsts] = True
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[lower] * power[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _STEP), starts


def word_hashes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, end of each text's words) for a string array."""
    values = values.cast(pa.large_string())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.array([], np.uint8)
    offsets = offsets - offsets[0]
    if len(data) <= 2 * RUN_BYTES:
        if not len(data):
            return np.array([], np.uint64), np.zeros(len(values), np.int64)
        hashes, starts = _word_hashes(data, offsets[:-1][offsets[:-1] < len(data)])
        return hashes, np.searchsorted(starts, offsets[1:])
    if np.count_nonzero(np.diff(offsets)) > 1:
        each = [word_hashes(values.slice(k, 1))[0] for k in range(len(values))]
        return np.concatenate(each), np.cumsum([len(hashes) for hashes in each])
    # One long text: cut it at blanks, so that the arrays stay small.
    parts, at = [], 0
    blanks = np.flatnonzero(data == 32)
    while at < len(data):
        end = at + RUN_BYTES
        k = int(np.searchsorted(blanks, end))
        end = int(blanks[k]) if k < len(blanks) else len(data)
        parts.append(_word_hashes(data[at:end], np.array([0]))[0])
        at = end
    hashes = np.concatenate(parts)
    ends = np.zeros(len(values), np.int64)
    ends[np.flatnonzero(np.diff(offsets) > 0)[0] :] = len(hashes)
    return hashes, ends


def shingle_sets(words: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one as a whole."""
    sums = np.zeros(len(words), np.uint64)
    for k in range(SHINGLE_WORDS):
        left = max(0, len(words) - k)
        sums[:left] = sums[:left] + words[k:] * _power(SHINGLE_WORDS)[0][k]
    whole = mix64(sums + np.uint64(SHINGLE_WORDS))
    start = 0
    for end in ends.tolist():
        n = end - start
        if n >= SHINGLE_WORDS:
            yield np.unique(whole[start : end - SHINGLE_WORDS + 1])
        elif n:
            part = (words[start:end] * _power(SHINGLE_WORDS)[0][:n]).sum(dtype=np.uint64)
            yield mix64(np.array([part + np.uint64(n)], np.uint64))
        else:
            yield np.array([], np.uint64)
        start = end


def batch_sets(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, text, RUN_BYTES):
            yield part, list(shingle_sets(*word_hashes(part.column(text))))


def set_digest(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    if not len(tokens):
        return 0
    mixed = mix64(tokens ^ _STEP)
    both = np.array([mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(mixed + _BASE))], np.uint64)
    return int(mix64(both[:1] * _BASE + mix64(both[1:] + np.uint64(len(tokens)))).view(np.int64)[0])
