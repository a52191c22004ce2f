"""Repeated strings against a count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from patronage.llm import suffix_dedup as S


def brute(rows):
    data = [(key, (text or "").encode()) for key, text in rows]
    seen = Counter(hash(b[k : k + S.LENGTH]) for _, b in data for k in range(len(b) - S.LENGTH + 1))
    for key, b in data:
        covered = bytearray(len(b))
        for k in range(len(b) - S.LENGTH + 1):
            if seen[hash(b[k : k + S.LENGTH])] > 1:
                covered[k : k + S.LENGTH] = b"\1" * S.LENGTH
        runs = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        left = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        yield key, len(b), sum(covered), runs, hashlib.sha256(left).hexdigest()


def texts(seed=5):
    chosen = random.Random(seed)
    part = lambda letters, n: "".join(chosen.choice(letters) for _ in range(n))
    passage = part("abcdefgh ", 450)
    out = [part("xyz ", chosen.randrange(300)) + passage[chosen.randrange(40) : 450 - chosen.randrange(40)] + part("uvw ", chosen.randrange(300)) for _ in range(60)]
    base = part("klmnop ", 2500)
    for _ in range(20):
        words = list(base)
        for _ in range(chosen.randrange(4)):
            words[chosen.randrange(len(words))] = "é"
        out.append("".join(words))
    out += [None, "", "a" * 1500, "ab" * 99 + "a" * 500 + "ab" * 101, "z" * 199, "z" * 199, "é" * 150 + "x", out[0], part("qr", 5000) * 2]
    return list(enumerate(out))


@pytest.mark.parametrize("spread", [False, True])
def test_equals_all_strings(spark, monkeypatch, spread):
    if spread:  # several shards per block, merged by binary search
        monkeypatch.setattr(S, "SHARD_CONTEXTS", 300)
        monkeypatch.setattr(S, "BLOCK_CONTEXTS", 5)
    rows = texts()
    found = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute(rows))


def test_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(tuple(r) for r in S.remove_repeats(docs).collect()) == sorted(brute(rows))


def test_odd_tables(odd, empty):
    assert S.remove_repeats(odd).count() == odd.count() and S.remove_repeats(empty).count() == 0


def test_suffix_order_and_prefixes():
    chosen = random.Random(1)
    pieces = ["".join(chosen.choice("ab") for _ in range(chosen.randrange(1, 60))).encode() * chosen.choice([1, 4]) for _ in range(30)]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    order, _ = S.suffix_order(data, np.repeat(ends, lengths))
    owner = np.repeat(np.arange(len(pieces)), lengths)
    suffix = [bytes(data[i : ends[owner[i]]]) for i in range(len(data))]
    assert order.tolist() == sorted(range(len(data)), key=lambda i: (suffix[i], i))
    shared = S.common_prefixes(data, ends - lengths, ends, order, least=0)
    for k in range(1, len(data)):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert shared[k] == min(n, S.LENGTH)


def test_pieces_mark_as_the_whole(monkeypatch):
    data = np.random.default_rng(0).integers(97, 100, 40_000).astype(np.uint8)
    whole = S.marked_blocks(data)
    monkeypatch.setattr(S, "PIECE", 3000)
    for a, b in zip(whole, S.marked_blocks(data), strict=True):
        assert a.tolist() == b.tolist()
