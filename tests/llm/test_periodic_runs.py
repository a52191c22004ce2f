"""Lyndon arrays, runs and collapsed texts against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from patronage.llm import periodic_runs


def lyndon(text):
    out = []
    for i in range(len(text)):
        j = i + 1
        while j < len(text) and text[j:] > text[i:]:
            j += 1
        out.append(j - i)
    return out


def numbered(text):
    numbers = {symbol: k for k, symbol in enumerate(sorted(set(text)))}
    return [numbers[symbol] for symbol in text], len(numbers)


def test_grouping_gives_lyndon_lengths():
    chosen = random.Random(1)
    for _ in range(4000):
        text, n = numbered([chosen.randrange(chosen.choice([1, 2, 3, 9])) for _ in range(chosen.randrange(1, 18))])
        assert periodic_runs.lyndon_lengths(text, n) == lyndon(text)
    assert periodic_runs.lyndon_lengths([], 0) == []


def brute_runs(words):
    found = set()
    for q in range(1, len(words) // 4 + 1):
        start = 0
        while start + q < len(words):
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            stretch = words[start : end + q]
            if end > start and len(stretch) >= max(6, 4 * q):
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.add((start, end + q, q))
            start = end + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def periodic(chosen, most=6):
    words, letters = [], chosen.randint(1, 5)
    for _ in range(chosen.randint(1, 6)):
        unit = [b"%d" % chosen.randrange(letters) for _ in range(chosen.randint(1, 7))]
        words += unit * chosen.randint(1, most) + unit[: chosen.randrange(len(unit) + 1)]
        words += [b"%d" % chosen.randrange(letters + 2) for _ in range(chosen.randint(0, 3))]
    return words


@pytest.mark.parametrize("cuts", [0, 3])
def test_runs_equal_brute_force(monkeypatch, cuts):
    monkeypatch.setattr(periodic_runs.stretches, "__defaults__", (0, cuts))
    chosen, total = random.Random(2), 0
    for _ in range(3000):
        words = periodic(chosen)
        expected = brute_runs(words)
        total += len(expected)
        assert periodic_runs.runs(words) == expected
    assert total > 3000


def test_nested_runs():
    unit = [b"a"] * 6 + [b"b"]
    words = unit * 5
    assert periodic_runs.runs(words) == brute_runs(words)
    assert len(periodic_runs.runs(words)) == 6
    assert periodic_runs.collapse(words, periodic_runs.runs(words)) == [b"a", b"b"] or len(periodic_runs.collapse(words, periodic_runs.runs(words))) < 7


def expected_row(key, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    best = max(found, key=lambda r: (Fraction(r[1] - r[0], r[2]), -r[0], -r[2]), default=None)
    strongest = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    kept = b" ".join(word for i, word in enumerate(words) if i not in gone)
    return (key, len(found), *strongest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_brute_force(spark):
    chosen = random.Random(3)
    rows = [(i, b" ".join(periodic(chosen)).decode()) for i in range(300)]
    rows += [(300 + i, " ".join(chosen.choice(["é", "B", "b", "漢"]) for _ in range(chosen.randrange(40)))) for i in range(60)]
    rows += [(400, None), (401, ""), (402, " \t\x0b\x0c\r\n"), (403, "a b " * 9), rows[5]]
    found = periodic_runs.run_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == sorted((expected_row(*row) for row in rows), key=str)
    assert sum(zlib.crc32(str(key).encode()) % 10 == 0 for key, _ in rows) > 20


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 6000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {tuple(r) for r in periodic_runs.run_digests(docs).collect()} == {expected_row(*row) for row in rows}


def test_odd_tables(spark, odd, empty):
    found = {r.doc_id: r for r in periodic_runs.run_digests(odd).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert found[0].n_runs == 0 and found[0].runs_sha256 == found[0].collapsed_sha256 == nothing
    assert periodic_runs.run_digests(odd).count() == odd.count()
    assert periodic_runs.run_digests(empty).count() == 0
    nameless = spark.createDataFrame([(None, "a b " * 9, "x"), (None, None, "y")], "doc_id string, text string, runs string")
    texts = sorted(r.collapsed for r in periodic_runs.find_runs(nameless, repeat=True).collect())
    assert texts == ["", "a b"]


def test_long_texts_take_time_in_proportion():
    chosen = random.Random(4)
    unit = [b"%d" % chosen.randrange(40) for _ in range(300)]
    assert periodic_runs.runs(unit * 500) == [(0, 150_000, 300)]
    assert periodic_runs.runs([b"a"] * 100_000) == [(0, 100_000, 1)]
    fibonacci = [b"a"], [b"a", b"b"]
    while len(fibonacci[1]) < 50_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert periodic_runs.runs(fibonacci[1]) == []  # no power above 3.62
