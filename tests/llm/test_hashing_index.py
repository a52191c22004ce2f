"""Multi-index hashing against a scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import hashing_index as H


def exact(rows, query, count):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    score = np.sqrt(((vectors - vectors[ids == query][0]) ** 2).sum(axis=1))
    order = [k for k in np.lexsort((ids, score)) if ids[k] != query][:count]
    return [(int(ids[k]), score[k]) for k in order]


def test_recall_on_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = H.search_table(spark, "/root/testdata/sf0.1").collect()
    hits = 0
    for query in {r.query_id for r in found}:
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == query)
        assert [r[0] for r in own] == list(range(1, 11)) and [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        truth = dict(exact(rows, query, 10))
        hits += len(truth.keys() & {v for _, v, _ in own})
        assert all(abs(truth[v] - s) < 1e-12 for _, v, s in own if v in truth)
    assert hits >= 0.9 * len(found) and len(found) == 10 * sum(i % 100 == 0 for i, _ in rows)


def test_within_is_the_whole_ball():
    chosen = np.random.default_rng(1)
    codes = chosen.integers(0, 256, (400, 16)).astype(np.uint8)
    codes[50:90] = codes[7]
    shard = H.Shard(np.arange(400), chosen.normal(size=(400, 4)), codes)
    for radius in (0, 1, 15, 16, 40, 55, 70, 128):
        apart = H.bits_apart(codes, codes[7])
        assert sorted(shard.within(codes[7], radius)) == np.flatnonzero(apart <= radius).tolist()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (8, []), (9, [1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, vector int")
    found = H.search(df, F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(r) for r in found) == [
        (0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 2, 5**0.5), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, 5**0.5)
    ]
    assert H.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert H.search(df, F.col("vec_id") == 77).count() == 0


@pytest.mark.parametrize("rows", [30, 64])
def test_several_shards_and_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(H, "SHARD_ROWS", rows)
    monkeypatch.setattr(H, "BLOCK_QUERIES", 3)
    vectors = np.random.default_rng(2).normal(size=(200, 8))
    table = [(i, v.tolist()) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    found = H.search(df, F.col("vec_id") % 20 == 0, 5).collect()
    good = sum((r.vec_id in dict(exact(table, r.query_id, 5))) for r in found)
    assert len(found) == 50 and good >= 45
