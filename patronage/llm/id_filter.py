"""A Bloom filter of ids, of a fixed size whatever their number; what it lets pass wrongly is joined away later."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 23


def _places(hashes: np.ndarray) -> list[np.ndarray]:
    h = hashes.view(np.uint64)
    return [(h >> np.uint64(shift)).astype(np.int64) & ((1 << FILTER_BITS) - 1) for shift in (0, 20, 40)]


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Bits that ``passing`` reads. A column of digests is taken as it is, others are hashed by xxhash64."""
    size = 1 << FILTER_BITS
    value = F.col(column) if column == "digest" else F.xxhash64(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            for at in _places(batch.column("hash").to_numpy()):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in ids.select(value.alias("hash")).repartition(8).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(out).astype(bool)


def passing(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first, second, third = _places(hashes)
    return bits[first] & bits[second] & bits[third]
