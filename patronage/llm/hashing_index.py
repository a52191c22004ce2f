"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: vectors of a bounded sample are centred and rotated so that their signs lose
least (iterative quantization); CODE_BITS signs, in blocks of as many as a vector has
components. Index: every row lies in one shard, which indexes each substring of
SUBSTRING_BITS bits of its codes. Search: codes within radius r of a query agree with
it up to r // substrings bits in some substring, so all values that close are probed,
the whole codes compared, and the vectors of those within r measured exactly. The
radius follows from the exact neighbours of a few queries among all rows; a shard
widens it for a query until it has enough neighbours there.

Every query reaches every shard, and each shard answers with its nearest rows only.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those whose length is not the usual one, nor rows
without id; ties go to the smaller id; rows with the query's own id are no candidates;
with fewer candidates than asked for all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.llm.common import table
from patronage.session import materialize

CODE_BITS = 128
SUBSTRING_BITS = 8
#: Rows that codes are learned from, and queries whose exact neighbours set the radius.
SAMPLE_ROWS = 10_000
PROBE_QUERIES = 64
#: Share of exact neighbours that the radius has to cover.
COVER = 0.985
SHARD_ROWS = 16_384
BLOCK_QUERIES = 4096
ROUNDS = 25


@dataclass(frozen=True)
class Coder:
    mean: np.ndarray
    rotations: np.ndarray  # component, bit

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Packed codes as bytes: a row per vector, a column per substring."""
        return np.packbits((vectors - self.mean) @ self.rotations > 0, axis=1)


def learn(sample: np.ndarray, seed: int = 0) -> Coder:
    size = sample.shape[1]
    mean = sample.mean(axis=0)
    centred, chosen, blocks = sample - mean, np.random.default_rng(seed), []
    for _ in range(-(-CODE_BITS // size)):
        rotation = np.linalg.qr(chosen.normal(size=(size, size)))[0]
        for _ in range(ROUNDS):
            signs = np.where(centred @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(centred.T @ signs)
            rotation = left @ right
        blocks.append(rotation)
    return Coder(mean, np.hstack(blocks)[:, :CODE_BITS])


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, components as doubles."""
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~bad & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def bits_apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


class Shard:
    """Index of the substrings of one shard's codes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.order = [np.argsort(column, kind="stable") for column in codes.T]
        counts = [np.bincount(column, minlength=256) for column in codes.T]
        self.offsets = [np.concatenate([[0], np.cumsum(x)]) for x in counts]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within ``radius`` of ``code``."""
        spread, over = divmod(radius, len(code))
        met = np.zeros(len(self.ids), bool)
        values = np.arange(256, dtype=np.uint8)
        for k, (order, offsets) in enumerate(zip(self.order, self.offsets, strict=True)):
            # Were all further apart than this, the sum would exceed the radius.
            near = np.flatnonzero(np.bitwise_count(values ^ code[k]) <= (spread if k <= over else spread - 1))
            for value in near[offsets[near] < offsets[near + 1]].tolist():
                met[order[offsets[value] : offsets[value + 1]]] = True
        rows = np.flatnonzero(met)
        return rows[bits_apart(self.codes[rows], code) <= radius]

    def nearest(self, own: int, query: np.ndarray, code: np.ndarray, radius: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        while True:
            rows = self.within(code, radius)
            rows = rows[self.ids[rows] != own]
            if len(rows) >= count or radius >= 8 * len(code):
                break
            radius = min(radius + len(code), 8 * len(code))
        score = distances(self.vectors[rows], query)
        best = np.lexsort((self.ids[rows], score))[:count]
        return self.ids[rows[best]], score[best]


def _radius(rows: DataFrame, queries: list, coder: Coder, count: int) -> int:
    """Hamming distance that covers the exact neighbours of a few queries."""
    ids, probes = np.array([q.vec_id for q in queries]), np.array([q.vector for q in queries])
    shared = rows.sparkSession.sparkContext.broadcast((ids, probes, coder.codes(probes), coder))

    def run(batches):
        ids, probes, codes, coder = shared.value
        for batch in batches:
            names, vectors = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"))
            own, found = coder.codes(vectors), []
            for i in range(len(ids)):
                score = distances(vectors, probes[i])
                score[names == ids[i]] = np.inf
                best = np.argsort(score, kind="stable")[:count]
                best = best[np.isfinite(score[best])]
                apart = bits_apart(own[best], codes[i])
                found += [(i, float(s), int(n), int(b)) for s, n, b in zip(score[best], names[best], apart, strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("probe", "score", "vec_id", "apart"), x, strict=True)) for x in found], SCHEMA)

    near = rows.mapInArrow(run, "probe int, score double, vec_id long, apart int")
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("score", "vec_id"))
    apart = [row.apart for row in near.withColumn("rank", rank).filter(F.col("rank") <= count).select("apart").collect()]
    return int(np.quantile(apart, COVER, method="higher")) if apart else CODE_BITS


SCHEMA = pa.schema([("probe", pa.int32()), ("score", pa.float64()), ("vec_id", pa.int64()), ("apart", pa.int32())])
FOUND = "query_id long, vec_id long, score double"


def search(df: DataFrame, is_query, count: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``count`` nearest rows of each row that ``is_query`` holds for.

    ``is_query`` is a condition on vec_id."""
    rows = materialize(usable(df, key, vector), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    spark = df.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("vector") == sizes["size"])
    order = F.xxhash64("vec_id")
    first = rows.select(order.alias("at"), "vec_id").orderBy("at", "vec_id").limit(SAMPLE_ROWS)
    last = first.agg(F.max("at")).first()[0]
    sample = rows.filter(order <= F.lit(last)).select("vector").limit(2 * SAMPLE_ROWS).collect()
    coder = learn(np.array([row.vector for row in sample]))
    probes = rows.filter(is_query).orderBy(order, "vec_id").limit(PROBE_QUERIES).collect()
    if not probes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    radius = _radius(rows, probes, coder, count)
    total = sizes["count"]
    shards = -(-total // SHARD_ROWS)
    blocks = -(-rows.filter(is_query).count() // BLOCK_QUERIES)
    shared = spark.sparkContext.broadcast((coder, radius))

    spread = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shards)).cast("int")
    base = rows.select("vec_id", "vector", spread.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = rows.filter(is_query).select(
        "vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"),
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        coder, radius = shared.value
        names = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        vectors, asked = matrix(left.column("vector")), matrix(right.column("vector"))
        shard = Shard(left.column("vec_id").to_numpy(), vectors, coder.codes(vectors))
        ids, codes, out = right.column("vec_id").to_numpy(), coder.codes(asked), []
        for own, query, code in zip(ids, asked, codes, strict=True):
            near, score = shard.nearest(own, query, code, radius, count)
            out.append((np.full(len(near), own), near, score))
        return pa.table([np.concatenate([x[k] for x in out]) for k in range(3)], schema=names)

    found = base.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(run, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= count).select("query_id", "rank", "vec_id", "score")


def search_table(spark, folder: str, every: int = 100, count: int = 10) -> DataFrame:
    return search(table(spark, folder, "embeddings"), F.col("vec_id") % every == 0, count)
