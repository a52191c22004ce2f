"""Product codes of vectors: exact nearest codebook entries by slices of sorted coordinates.

Components x become the integers floor(1024 * x). A vector is cut into ``PARTS`` equal
parts; each part position has a codebook, which starts as that part of the ``ENTRIES``
rows of smallest id. In each of ``ROUNDS`` rounds every part goes to its nearest entry
and every entry becomes the componentwise floor(sum / count) of its parts.

Nearest entry (``Slices``): per dimension the entries' coordinates are sorted, and a mask
of 64-bit words tells which entries the first t of them are. For a part and a radius, two
binary searches per dimension give a range of the sorted coordinates, two prefix masks
its entries, and all dimensions' masks ANDed the entries within the radius in each
dimension. They are measured exactly. If the best lies within the radius, it is the
nearest, as are its ties; else the radius becomes the distance of the best, or doubles if
there is none. All arithmetic is in integers.

A round is one scan: each task adds up its parts by entry, Spark adds up the tasks, and
what returns to the driver has one row per part position and entry. The sum of errors of
a label is joined back: labels with at least one row in ``HOT_SHARE``, of which there are
at most ``HOT_SHARE``, are broadcast, the others meet their rows by a shuffle.

Defined results: rows whose vector is null or holds null or non-finite components are left
out; ties go to the lower entry; with fewer rows than entries the codebook is smaller; rows without id are
coded but start no entry; of repeated ids those with the smaller vector come first; null
labels are one label; an empty table gives no rows. Vectors of different lengths, of a
length that ``PARTS`` does not divide, or with components beyond ``LARGEST`` raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Bound of integer components, for which squared distances of 512 of them fit 64 bits.
LARGEST = 1 << 26
#: Parts that are measured at once.
CHUNK = 2048
HOT_SHARE = 10_000


class Slices:
    """The entries of one codebook, ready for exact nearest-entry search."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, size = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(entries, order, 0).T)
        own = np.zeros((n, -(-n // 64)), np.uint64)
        own[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n, dtype=np.uint64) % np.uint64(64))
        #: dimension, t: mask of the t entries with the smallest coordinates.
        self.prefix = np.zeros((size, n + 1, own.shape[1]), np.uint64)
        for j in range(size):
            np.bitwise_or.accumulate(own[order[:, j]], axis=0, out=self.prefix[j, 1:])
        self.radius = self._between() if n > 1 else 1

    def _between(self) -> int:
        """Median distance of an entry to its nearest other one: where searches begin."""
        nearest = []
        for k, entry in enumerate(self.entries):
            distance = ((self.entries - entry) ** 2).sum(axis=1)
            nearest.append(np.delete(distance, k).min())
        return max(1, int(np.sqrt(np.median(nearest))))

    def within(self, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """part, entry: whether the entry is within the part's radius in every dimension."""
        mask = np.full((len(parts), self.prefix.shape[2]), ~np.uint64(0))
        for j, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix, strict=True)):
            low = np.searchsorted(coordinates, parts[:, j] - radius, "left")
            high = np.searchsorted(coordinates, parts[:, j] + radius, "right")
            mask &= prefix[high] & ~prefix[low]
        bits = np.unpackbits(mask.astype("<u8").view(np.uint8), axis=1, count=len(self.entries), bitorder="little")
        return bits.astype(bool)

    def _measured(self, parts: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry, squared distance) of the best candidate of each part that has any."""
        row, entry = np.nonzero(self.within(parts, radius))
        distance = np.zeros(len(row), np.int64)
        for j in range(parts.shape[1]):
            difference = parts[row, j] - self.entries[entry, j]
            distance += difference * difference
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        if not len(starts):
            return row, entry, distance
        least = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == np.repeat(least, np.diff(starts, append=len(row))))
        first = hits[np.flatnonzero(np.diff(row[hits], prepend=-1))]  # entries ascend, so ties go to the lower
        return row[first], entry[first], distance[first]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part's nearest entry."""
        best, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for at in range(0, len(parts), CHUNK):
            open_ = np.arange(at, min(at + CHUNK, len(parts)))
            radius = np.full(len(open_), self.radius, np.int64)
            while len(open_):
                row, entry, distance = self._measured(parts[open_], radius)
                sure = distance <= radius[row] ** 2
                best[open_[row[sure]]], least[open_[row[sure]]] = entry[sure], distance[sure]
                radius *= 2
                radius[row] = np.ceil(np.sqrt(distance.astype(np.float64))).astype(np.int64) + 1
                left = np.ones(len(open_), bool)
                left[row[sure]] = False
                open_, radius = open_[left], radius[left]
        return best, least


def integers(column: pa.Array, size: int | None = None) -> np.ndarray:
    """row, component: floor(1024 * x) of vectors of equal length."""
    lengths = np.diff(column.offsets.to_numpy())
    size = int(lengths[0]) if size is None and len(lengths) else size
    if len(lengths) and (lengths != size).any():
        raise ValueError("vectors differ in length")
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    if len(values) and np.abs(values).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} in size")
    return values.astype(np.int64).reshape(len(lengths), size or 0)


@dataclass(frozen=True)
class Codebooks:
    """part, entry, component."""

    entries: np.ndarray

    @property
    def length(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def slices(self) -> list[Slices]:
        return [Slices(entries) for entries in self.entries]

    def split(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        size = self.entries.shape[2]
        return (np.ascontiguousarray(vectors[:, k * size : (k + 1) * size]) for k in range(len(self.entries)))


def usable(df: DataFrame, key: str, vector: str, *more: str) -> DataFrame:
    """(vec_id, vector, ...) of the rows with a vector of finite components, as doubles."""
    rows = df.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"), *(F.col(f"`{c}`").alias("label") for c in more))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vector").isNotNull() & ~bad)


def first_entries(rows: DataFrame) -> Codebooks | None:
    """The parts of the rows of smallest id; None without rows."""
    first = rows.select("vec_id", "vector").filter("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(ENTRIES).collect()
    if not first:
        return None
    vectors = integers(pa.array([row.vector for row in first], pa.list_(pa.float64())))
    if not vectors.shape[1] or vectors.shape[1] % PARTS:
        raise ValueError(f"vectors of {vectors.shape[1]} components have no {PARTS} equal parts")
    return Codebooks(vectors.reshape(len(first), PARTS, -1).transpose(1, 0, 2))


def _sums(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """part, entry, n and the components' sums c0, c1, ... of the parts that chose it."""
    shared = rows.sparkSession.sparkContext.broadcast(codebooks)  # PARTS * ENTRIES parts of vectors
    parts, n_entries, size = codebooks.entries.shape
    names = ["part", "entry", "n", *(f"c{j}" for j in range(size))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        slices = books.slices()
        n, sums = np.zeros((parts, n_entries), np.int64), np.zeros((parts, n_entries, size), np.int64)
        for batch in batches:
            for k, (part, own) in enumerate(zip(books.split(integers(batch.column("vector"), books.length)), slices, strict=True)):
                chosen = own.nearest(part)[0]
                n[k] += np.bincount(chosen, minlength=n_entries)
                np.add.at(sums[k], chosen, part)
        part, entry = np.nonzero(n)
        columns = [part, entry, n[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names)

    found = rows.select("vector").mapInArrow(run, ", ".join(f"{name} long" for name in names))
    return found.groupBy("part", "entry").agg(*(F.sum(name).alias(name) for name in names[2:]))


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> Codebooks | None:
    """Codebooks after ``ROUNDS`` rounds over all rows; None without usable rows."""
    rows = usable(df, key, vector)
    books = first_entries(rows)
    for _ in range(ROUNDS if books else 0):
        entries = books.entries.copy()
        for part, entry, n, *sums in _sums(rows, books).collect():  # PARTS * ENTRIES rows at most
            entries[part, entry] = [total // n for total in sums]
        books = Codebooks(entries)
    return books


def encode(df: DataFrame, codebooks: Codebooks | None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, entries (the chosen entry of each part) and error of the usable rows."""
    shared = df.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        slices = books.slices() if books else []
        for batch in batches:
            if books is None:  # no row has an id, so no entry exists
                continue
            found = [own.nearest(part) for part, own in zip(books.split(integers(batch.column("vector"), books.length)), slices, strict=True)]
            chosen = np.stack([entry for entry, _ in found], axis=1).astype(np.int32)
            offsets = np.arange(0, chosen.size + 1, PARTS, dtype=np.int32)
            entries = pa.ListArray.from_arrays(pa.array(offsets), pa.array(chosen.ravel()))
            error = sum(distance for _, distance in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), entries, pa.array(error)], ["vec_id", "label", "entries", "error"])

    rows = usable(df, key, vector, label)
    kinds = {name: rows.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, entries array<int>, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """Stored rows of ``encode`` with label_error, the sum of the errors of their label."""
    sums = materialize(coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("error").alias("label_error")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.filter(F.col("n") * HOT_SHARE >= total).select(F.col("label").alias("of"), "label_error")  # at most HOT_SHARE rows
    same = F.col("label").eqNullSafe(F.col("of"))
    cold = sums.filter(F.col("n") * HOT_SHARE < total).select(F.col("label").alias("of"), "label_error")
    sides = [coded.join(F.broadcast(hot), same), coded.join(F.broadcast(hot), same, "left_anti").join(cold, same)]
    return reduce(DataFrame.unionByName, (side.select("vec_id", "entries", "error", "label_error") for side in sides))


def coded_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error and the codebooks' digest."""
    books = fit(df, key, vector)
    coded = materialize(encode(df, books, key, vector, label), "codes")
    return with_label_error(coded).select(
        "vec_id",
        F.concat_ws("", F.transform("entries", lambda e: F.lower(F.lpad(F.hex(e), 2, "0")))).alias("code"),
        "error",
        "label_error",
        F.lit(books.sha256() if books else Codebooks(np.zeros((0, 0, 0), np.int64)).sha256()).alias("codebooks_sha256"),
    )
