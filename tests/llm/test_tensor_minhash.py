"""MinHash with tensored banding against all pairs, and against SQL."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from patronage.llm import open_buckets, parities, tensor_minhash
from patronage.llm.oracles import ORACLES
from patronage.llm.queries import QUERIES

from compare import assert_same, connect


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(zip(words, words[1:], strict=False)) if len(words) > 1 else frozenset(words)


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
    return {(key, len(x), find(key), find(key) == key) for key, x in sets}


def copies(seed, groups=14, most=25):
    """Groups of copies with up to five words changed, many around the threshold; half share a passage."""
    chosen = random.Random(seed)
    word = lambda: "".join(chosen.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(40)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(chosen.choice([1, 2, 5, 30, 60, 140]))] + (passage if chosen.random() < 0.5 else [])
        for _ in range(chosen.randrange(1, most)):
            words = list(base)
            for _ in range(chosen.randrange(6)):
                words[chosen.randrange(len(words))] = word()
            out.append(" ".join(words))
    return [(3 * i + 1, text) for i, text in enumerate(chosen.sample(out, len(out)))]


@pytest.mark.parametrize("cell", [256, 3])
def test_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(open_buckets, "CELL", cell)  # 3: buckets fall into many groups
    rows = copies(4) + [(9001, None), (9002, ""), (9003, " \n "), (9004, "A b"), (9005, "a  B"), (9006, "one"), (9007, "ONE"), (9008, "a a a")]
    found = tensor_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_hot_template_without_links(spark):
    """Texts of one template that share buckets but do not link: none is left out, none is linked."""
    chosen = random.Random(6)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in chosen.sample(range(100), 9):
            words[k] = f"x{i}y{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 300, 50)]
    found = tensor_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in found.collect()} == brute(rows)


def test_groups_are_found_in_comparisons_in_proportion(spark):
    """Every group of cells holds a bounded number of nodes, and a bucket of one component has none."""
    rows = spark.createDataFrame([(7, node) for node in [*range(5000), 9001, 9002]] + [(8, 1), (8, 2)], "key long, node long")
    labels = spark.createDataFrame([(node, 0) for node in range(5000)] + [(9002, 9001)], "id long, component long")
    groups = open_buckets.groups_of(open_buckets.open_rows(rows, labels))
    sizes = groups.groupBy("key", "x", "y", "outside").count().collect()
    assert {r.key for r in sizes} == {7}
    assert max(r["count"] for r in sizes) < 2 * open_buckets.CELL
    met = {(r.x, r.y) for r in sizes if r.outside}
    assert met == {(r.x, r.y) for r in sizes if not r.outside} and len(met) == -(-5002 // open_buckets.CELL)
    assert groups.filter("outside AND node = 9001").count() == len(met)


def test_parity_bits_never_rule_out_a_link():
    chosen = np.random.default_rng(7)
    for n, m, changed in ((1, 1, 0), (9, 9, 1), (90, 81, 9), (700, 690, 77), (1200, 1000, 90)):
        pool = chosen.integers(0, 2**63, n + changed, dtype=np.uint64)
        sets = [pool[:n], pool[changed : changed + m], chosen.integers(0, 2**63, n, dtype=np.uint64)]
        bits = parities.Parities(np.array([len(x) for x in sets]), pa.array([parities.parity_bits(x) for x in sets]))
        linked = len(np.intersect1d(*sets[:2])) * 5 >= len(np.union1d(*sets[:2])) * 4
        assert linked and bits.may_link(0, np.array([1, 0])).all()
        assert n < 9 or not bits.may_link(0, np.array([1, 2]))[1]


def test_probability_of_meeting():
    chosen = np.random.default_rng(5)
    missed = agree = 0
    for _ in range(4000):
        pool = chosen.integers(0, 2**63, 90, dtype=np.uint64)
        left, right = tensor_minhash.minhashes([np.unique(pool[:81]), np.unique(pool[9:])])  # similarity 72 / 90 = 0.8
        keys = tensor_minhash.table_keys(np.stack([left, right]))
        missed += not np.intersect1d(*keys).size
        agree += int((left == right).sum())
    assert missed <= 4  # 7e-5 expected
    assert abs(agree / 4000 / tensor_minhash.HASHES - 0.8) < 0.01


def test_keys_need_far_fewer_hashes_than_tables():
    assert tensor_minhash.HASHES == 40
    assert tensor_minhash.table_keys(np.zeros((1, 40), np.uint32)).shape == (1, 100)
    assert len(np.unique(tensor_minhash.table_keys(np.zeros((1, 40), np.uint32)))) == 100


def test_keys_that_several_texts_share(spark):
    rows = [(1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "p q r s t u v w"), (2, "p q r s t u v w"), (3, "k l m"), (None, "k l m"), (None, None)]
    found = tensor_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found if r.doc_id is not None) == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True)]
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, None)] * 2


def test_odd_tables(odd, empty):
    found = {r.doc_id: r for r in tensor_minhash.near_duplicates(odd).collect()}
    assert found[0].n_shingles == found[1].n_shingles == found[2].n_shingles == 0
    assert found[4].component_id == 3 and found[0].kept
    assert tensor_minhash.near_duplicates(odd).count() == odd.count()
    assert tensor_minhash.near_duplicates(empty).count() == 0


def test_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert assert_same(QUERIES["op12_tensor_minhash"](spark, folder), connect(folder), ORACLES["op12_tensor_minhash"]) == 1000
