"""Helpers shared by the training-data operators: arrow batches, vocabularies, paths."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that a task turns into arrays at once; those arrays take some ten times as much.
SLICE_BYTES = 2 << 20


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, giving freed memory back to the system when a task ends.

    Spark keeps Python workers for later tasks; without this the idle ones hold on to what
    their largest arrays took, beside those that work."""

    def tidied(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return tidied


@contextmanager
def small_batches(spark: SparkSession, limit: int = SLICE_BYTES) -> Iterator[None]:
    """Steps that run in this block get batches of about ``limit`` bytes at most, at least a row each.

    Spark's own bounds are 10,000 rows and 64 MB, which each task holds several times: in the
    executor's buffers, on the way, and in the Python worker. A lower bound of the caller stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    own = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    spark.conf.set(name, str(min(limit, own) if own > 0 else limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(column: pa.Array) -> list[str]:
    """Values as strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes in a string or binary
    column. A longer value stays whole, in a run of its own."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    long = lengths > limit
    run = np.cumsum(np.where(long, 0, lengths).astype(np.int64)) // limit
    new = np.diff(run, prepend=run[0] - 1) != 0
    new |= long
    new[1:] |= long[:-1]
    starts = np.flatnonzero(new)
    for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(start, end - start)


def keyed_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that text operators read, whatever else a table holds."""
    return df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def vocabulary(name: str) -> tuple[bytes, str]:
    """Bytes of a tokenizer file (under 2 MB each) and the pattern that splits text.

    The driver reads the file and sends it along, so executors need no copy."""
    import public_tokenizers

    if not os.path.isabs(name):
        name = public_tokenizers.path(name)
    with open(name, "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of the input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
