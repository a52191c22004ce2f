"""The Jaccard join against all pairs."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from patronage.llm import ngram_join
from patronage.llm.common import SLICE_BYTES, small_batches
from patronage.llm.components import components


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [(key, shingles(text)) for key, text in rows]
    parent = {key: key for key, _ in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {(key, len(x), find(key)) for key, x in sets}


def copies(seed=4, groups=12, most=25):
    chosen = random.Random(seed)
    word = lambda: "".join(chosen.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(chosen.choice([1, 3, 5, 8, 60, 140]))] + (passage if chosen.random() < 0.5 else [])
        for _ in range(chosen.randrange(1, most)):
            words = list(base)
            for _ in range(chosen.randrange(4)):
                words[chosen.randrange(len(words))] = word()
            out.append(" ".join(words))
    return [(3 * i + 1, text) for i, text in enumerate(chosen.sample(out, len(out)))]


@pytest.mark.parametrize("load", ["usual", "adaptive"])
def test_equals_all_pairs(spark, monkeypatch, load):
    if load == "adaptive":  # any match is dear, so prefixes get longer
        monkeypatch.setattr(ngram_join, "VERIFY_COST", 50.0)
    rows = copies() + [(9001, None), (9002, ""), (9003, "  "), (9004, "A b"), (9005, "a  B")]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_pairs_meet_by_a_shuffle_as_well(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_PAIRS", 0)
    rows = copies(seed=5, groups=6)
    assert {tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in ngram_join.near_duplicates(docs).collect()} == brute(rows)


def test_odd_tables(odd, empty):
    found = {r.doc_id: r for r in ngram_join.near_duplicates(odd).collect()}
    assert found[0].n_shingles == found[1].n_shingles == found[2].n_shingles == 0
    assert found[4].component_id == 3 and found[0].component_id == 0
    assert ngram_join.near_duplicates(odd).count() == odd.count()
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(16) if i != 4]


def large_between_short(item="one two three four five six seven eight nine ten eleven twelve"):
    """A text of 5 MiB with short ones around it, which repeat each other."""
    large = " ".join(f"w{i % 977}x{i}" for i in range(500_000))
    assert len(large) > 5 << 20
    return [(1, "a b c d e f g"), (2, large), (3, "a b c d e f g"), (4, f"{item} after"), (5, None), (6, f"{item} after"), (7, "short"), (8, large)]


def test_large_text_between_short_ones(spark):
    rows = large_between_short()
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_runs_of_rows():
    from patronage.llm.common import slices
    from patronage.llm.shingles import word_hashes

    import pyarrow as pa

    batch = pa.record_batch({"text": ["a" * n for n in (5 << 20, 10_000, 10_000, 3 << 20, 3 << 20, 10)]})
    assert [part.num_rows for part in slices(batch, "text")] == [1, 2, 1, 1, 1]
    hashes, ends = word_hashes(pa.array(["a b " * (1 << 20), None, "b a", "a b " * (1 << 20)]))
    assert ends.tolist() == [2 << 20, 2 << 20, (2 << 20) + 2, (4 << 20) + 2]
    assert (hashes[2 << 20 : (2 << 20) + 2] == hashes[1::-1]).all()


def test_rows_of_one_key(spark):
    """Different texts under one key are judged apart; a copy goes, what is unique stays."""
    base = [f"word{k}" for k in range(60)]
    near = " ".join([*base[:-1], "other"])
    unique, apart = (" ".join(f"{x}{k}" for k in range(40)) for x in ("u", "v"))
    rows = [(1, " ".join(base), "a"), (2, " ".join(base), "b"), (2, unique, "c"), (3, near, "d"), (3, apart, "e"),
            (3, apart, "f"), (4, "", "g"), (None, unique, "h"), (None, unique, "i"), (5, None, "j")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string, note string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted(
        [(1, rows[0][1]), (2, unique), (3, apart), (4, ""), (5, ""), (0, unique), (0, unique)]
    )


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r.id: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_levels_follow_the_cost():
    import numpy as np

    tokens = np.arange(100, dtype=np.uint64)
    rare = ngram_join._prefix(tokens, np.full(100, 1.0), 1.0)
    assert rare[1] == 1 and len(rare[0]) == 100 - ngram_join.needed(100) + 1
    common = ngram_join._prefix(tokens, np.full(100, 1e6), 1.0)
    assert common[1] > 1 and len(common[0]) == 100 - ngram_join.needed(100) + common[1]


def test_parity_bits_never_claim_too_much():
    import numpy as np

    chosen = np.random.default_rng(0)
    for n, m in ((3, 3), (100, 90), (600, 500), (300, 250), (40, 200)):
        pool = chosen.integers(0, 2**63, n + m, dtype=np.uint64)
        x, y = pool[:n], np.concatenate([pool[: min(n, m) * 3 // 4], pool[n : n + m - min(n, m) * 3 // 4]])
        bits = []
        for tokens in (x, y):
            cells = 1 << max(ngram_join.LEAST_CELLS, (2 * len(tokens) - 1).bit_length())
            odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
            bits.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
        assert 0 < ngram_join.least_difference(*bits) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_only_rows_that_may_be_first_bring_bits(spark, monkeypatch):
    """Texts of sizes too far apart share a passage, and so shingles of their prefixes: their rows go before the groups."""
    parts = [" ".join(f"p{n}x{k}" for k in range(n)) for n in (100, 200)]
    rows = [(1, parts[0]), (2, parts[1]), (3, " ".join(parts))]
    seen = []
    real = ngram_join._cross_pairs

    def watched(groups, summaries):
        seen.append(groups.count())
        return real(groups, summaries)

    monkeypatch.setattr(ngram_join, "_cross_pairs", watched)
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == brute(rows)
    assert seen == [0]


@pytest.mark.parametrize("small", [1, 64])
def test_rows_of_buckets_of_any_size(spark, small, monkeypatch):
    """In small and large buckets a row stays if it may be the first shared shingle of a similar pair."""
    monkeypatch.setattr(ngram_join, "SMALL_BUCKET", small)
    rows = [(1, a, 100, 95) for a in range(3)] + [(2, 0, 100, 95), (2, 1, 100, 85)] + [(3, 0, 100, 100), (3, 1, 130, 130)]
    left = spark.createDataFrame(rows, "key long, node long, n int, rest int")
    labels = spark.createDataFrame([(2, 1)], "id long, component long")
    open_rows = ngram_join.open_rows(left, labels, sized=True)
    kept = {(r.key, r.node) for r in ngram_join._may_be_first(open_rows).collect()}
    assert kept == ({(1, 0), (1, 1), (1, 2)} if small == 64 else {row[:2] for row in rows})


def test_folded_bits_never_claim_too_much():
    import numpy as np

    from patronage.llm.parities import parity_bits

    pool = np.random.default_rng(3).integers(0, 2**63, 1100, dtype=np.uint64)
    for n in (3, 256, 257, 1000):
        x, y = pool[:n], pool[n // 10 : n + n // 10]
        whole, half = ([f(parity_bits(v)) for v in (x, y)] for f in (lambda v: v, ngram_join.folded))
        assert len(half[0]) == max(len(whole[0]) // 2, (1 << ngram_join.LEAST_CELLS) // 8)
        assert ngram_join.least_difference(*half) <= ngram_join.least_difference(*whole) <= len(np.setxor1d(x, y))


def test_python_steps_get_small_batches(spark, monkeypatch):
    name, given, inside = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), []

    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])

    real, table = ngram_join._described, spark.range(3000).coalesce(1).select(F.repeat(F.lit("x"), 2000).alias("text"))

    def watched(docs):
        inside.append(max(r.size for r in table.mapInArrow(size, "size long").collect()))
        return real(docs)

    monkeypatch.setattr(ngram_join, "_described", watched)
    rows = copies(seed=8, groups=2)
    assert {tuple(r) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == brute(rows)
    assert inside[0] < 1.1 * SLICE_BYTES and spark.conf.get(name) == given
    monkeypatch.setattr(ngram_join, "_described", lambda docs: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert spark.conf.get(name) == given
    try:  # a lower bound of the caller stays
        spark.conf.set(name, "1k")
        with small_batches(spark):
            assert spark.conf.get(name) == "1024"
        assert spark.conf.get(name) == "1k"
    finally:
        spark.conf.set(name, given)
