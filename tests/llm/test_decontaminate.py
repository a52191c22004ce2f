"""Benchmark passages: exact and edited copies are found, nothing else."""

import random

import numpy as np
import pytest

from patronage.llm import decontaminate as D
from patronage.llm.shingles import word_hashes


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")


def edited(chosen, words, rate):
    words = list(words)
    for _ in range(int(rate * len(words))):
        at, kind = chosen.randrange(len(words)), chosen.randrange(3)
        words[at : at + (kind < 2)] = [f"zz{chosen.randrange(99)}"] * (kind != 1)
    return words


def test_edited_passages(items):
    rows = items.collect()
    texts = [r.text for r in rows]
    words = D.words_of(texts)
    table = D.Items([r.item_id for r in rows], words, D.walks_needed(words))
    chosen = random.Random(3)
    for rate, least in ((0.0, 1.0), (0.05, 0.97), (0.1, 0.95)):
        hits = tries = 0
        for k, text in enumerate(texts * 3):
            k %= len(texts)
            inside = " ".join(edited(chosen, text.split(), rate))
            words, ends = word_hashes(D.pa.array([f"some {k} words in front {inside} and behind", "", None, "other words"]))
            found = D.matches(table, words, ends)
            hits += k in found[0]
            tries += 1
            assert not any(found[1:]) and set(found[0]) <= {k}
        assert hits >= least * tries


@pytest.mark.parametrize("size", [8, 10, 15, 40, 80])
def test_recall_by_length(size):
    """Verbatim passages are always found, those with all edits that are allowed nearly always."""
    chosen = random.Random(size)
    texts = [" ".join(f"w{chosen.randrange(3000)}" for _ in range(size)) for _ in range(300)]
    items = D.words_of(texts)
    table = D.Items(list(range(len(texts))), items, D.walks_needed(items))
    for rate, least in ((0.0, 1.0), (0.1, 0.95), (0.2, 0.95)):
        docs = [f"some words in front {' '.join(edited(chosen, x.split(), rate + 1e-9))} and some behind" for x in texts]
        found = D.matches(table, *word_hashes(D.pa.array(docs)))
        assert sum(k in x for k, x in enumerate(found)) >= least * len(texts)


def test_verbatim_without_other_walks():
    chosen = random.Random(9)
    texts = [" ".join(f"w{chosen.randrange(50)}" for _ in range(chosen.randrange(8, 40))) for _ in range(300)]
    table = D.Items(list(range(300)), D.words_of(texts), [D._walk(None, 0)])
    assert all(x[k] == 0 for k, x in enumerate(D.matches(table, *word_hashes(D.pa.array(texts)))))


def test_a_row_for_each_row(spark, monkeypatch):
    item = " ".join(f"passage{k}" for k in range(12))
    rows = [(1, f"x {item} y"), (1, "clean text"), (None, item), (None, "clean text"), (None, None), (1, f"x {item} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "clean text"), (9, "absent words")], "item_id long, text string")
    expected = sorted([(1, "7"), (1, "8"), (0, "7"), (0, "8"), (0, ""), (1, "7")])
    for most in (D.BLOCK_WORDS, 2):
        monkeypatch.setattr(D, "BLOCK_WORDS", most)
        assert sorted((r.doc_id or 0, r.item_ids) for r in D.leaks_by_document(docs, items).collect()) == expected


def test_distance_by_brute_force():
    chosen = random.Random(0)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(200):
        a, b = ([chosen.randrange(4) for _ in range(chosen.randrange(1, 12))] for _ in range(2))
        assert D.fitting_distance(np.array(a), np.array(b))[0] == plain(a, b)


def test_given_documents(spark, small, items):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r.doc_id: r.item_ids for r in D.leaks_by_document(docs, items).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for key, text in texts.items():
        exact = sorted(r.item_id for r in items.collect() if r.text in text)
        assert set(map(str, exact)) <= set(found[key].split(","))
    kept = {r.doc_id for r in D.remove_contaminated(docs, items).collect()}
    assert kept == {key for key in texts if not found[key]}


def test_short_and_equal_items(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, None), (4, ""), (5, "w0x0")], "item_id long, text string")
    found = {r.doc_id: r.item_ids for r in D.leaks_by_document(odd, items).collect()}
    assert found[3] == found[4] == "1,2" and found[0] == found[1] == "" and found[5] == "1,2" and found[6] == "5"
    assert D.leaks_by_document(empty, items).count() == 0
    assert D.remove_contaminated(odd, items).columns == odd.columns
    assert D.remove_contaminated(odd, items.limit(0)).count() == odd.count()
    assert not any(r.contaminated for r in D.leaks_by_document(odd, items.limit(0)).collect())


def test_short_document_after_a_large_one(spark):
    from test_near_duplicates import large_between_short

    item = " ".join(f"passage{k}" for k in range(40))
    docs = spark.createDataFrame(large_between_short(item), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in D.leaks_by_document(docs, items).collect() if r.contaminated} == {4, 6}
    assert {r.doc_id for r in D.remove_contaminated(docs, items).collect()} == {1, 2, 3, 5, 7, 8}


def test_blocks_of_items(spark, small, items, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = sorted(D.leaks_by_document(docs, items).collect())
    monkeypatch.setattr(D, "BLOCK_WORDS", 300)
    assert sorted(D.leaks_by_document(docs, items).collect()) == once
