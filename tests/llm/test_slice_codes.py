"""Product codes against a search through all entries, and against SQL."""

import hashlib
import math

import numpy as np
import pytest

from patronage.llm import slice_codes
from patronage.llm.oracles import ORACLES
from patronage.llm.queries import QUERIES

from compare import assert_same, connect


@pytest.mark.parametrize("scale, size", [(3, 1), (3, 4), (600, 16), (1 << 20, 5)])
@pytest.mark.parametrize("n_entries", [1, 2, 64, 65, 256])
def test_nearest_equals_all_entries(scale, size, n_entries):
    chosen = np.random.default_rng(scale + size)
    entries = chosen.integers(-scale, scale + 1, (n_entries, size))
    parts = np.concatenate([chosen.integers(-3 * scale, 3 * scale, (300, size)), entries[:5]])
    best, least = slice_codes.Slices(entries).nearest(parts)
    gaps = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (least == gaps.min(axis=1)).all()
    assert (best == gaps.argmin(axis=1)).all()  # ties to the lower entry


def brute(rows, entries=256, parts=4, rounds=4):
    """Plain Python form of the whole operator for rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][1]) // parts
    cut = lambda v: [v[p * size : (p + 1) * size] for p in range(parts)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    books = [[cut(v)[p] for _, v, _ in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min((gap(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        own = [[[] for _ in first] for _ in range(parts)]
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                own[p][nearest(part, books[p])[1]].append(part)
        books = [[[sum(c) // len(c) for c in zip(*own[p][k], strict=True)] if own[p][k] else e for k, e in enumerate(books[p])] for p in range(parts)]
    coded, errors = [], {}
    for i, v, lab in kept:
        found = [nearest(part, books[p]) for p, part in enumerate(cut(v))]
        coded.append((i, lab, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
        errors[lab] = errors.get(lab, 0) + coded[-1][3]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((i, code, error, errors[lab], digest) for i, lab, code, error in coded)


SCHEMA = "label string, error int, vec_id long, embedding array<float>, part int, n int, of string"


def table(spark, rows):
    return spark.createDataFrame([(lab, 1, i, v, 2, 3, "x") for i, v, lab in rows], SCHEMA)


@pytest.mark.parametrize("hot_share", [10_000, 3])
def test_equals_brute_force(spark, monkeypatch, hot_share):
    monkeypatch.setattr(slice_codes, "HOT_SHARE", hot_share)  # 3: most labels meet their rows by a shuffle
    chosen = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in chosen.normal(size=8)], chosen.choice(["a", "b", "c", None])) for i in chosen.permutation(400)]
    rows += [rows[0], rows[1], (500, rows[2][1], "only"), (501, None, "a"), (502, [1.0] * 7 + [None], "a"), (503, [math.nan] * 8, "b"), (504, [math.inf] * 8, None)]
    assert sorted(tuple(r) for r in slice_codes.coded_vectors(table(spark, rows)).collect()) == brute(rows)


def test_few_rows_and_none(spark):
    few = [(7, [0.5, 0.25, -1.0, 2.0], None), (3, [0.5, 0.25, -1.0, 2.5], "a"), (3, [0.5, 0.25, -1.0, 2.25], "a")]
    assert sorted(tuple(r) for r in slice_codes.coded_vectors(table(spark, few)).collect()) == brute(few)
    without_id = table(spark, [*few, (None, [9.0] * 4, "a")])
    assert slice_codes.coded_vectors(without_id).filter("vec_id IS NULL").count() == 1
    assert slice_codes.coded_vectors(table(spark, [])).collect() == []
    assert slice_codes.coded_vectors(table(spark, [(None, [9.0] * 4, "a")])).collect() == []


@pytest.mark.parametrize("vectors", [[[1.0] * 4, [1.0] * 8], [[1.0] * 6], [[1e9] * 4]])
def test_vectors_that_have_no_code_raise(spark, vectors):
    with pytest.raises(Exception, match="differ in length|equal parts|beyond"):
        slice_codes.coded_vectors(table(spark, [(i, v, None) for i, v in enumerate(vectors)])).collect()


def test_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert assert_same(QUERIES["op11_slice_codes"](spark, folder), connect(folder), ORACLES["op11_slice_codes"]) == 500
