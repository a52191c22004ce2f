"""Byte-level BPE and piece counts against the libraries."""

import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from patronage.llm import byte_bpe, piece_counts
from patronage.llm.common import vocabulary


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary(byte_bpe.VOCABULARY)[0].splitlines())}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_counts.MODEL))
    return encoding, pieces


def strange(n=150):
    chosen = random.Random(1)
    some = ["a" * 5000, "ab" * 3000, "  \n\n x  ", "0" * 700, "▁▁x y\x00​", " " * 90, "\t \n", "é" * 2500 + "漢字😀"]
    some += ["".join(chosen.choice("etaoin ") for _ in range(3000)), "".join(chosen.choice("etaoin") for _ in range(9000))]
    return some + ["".join(chr(chosen.randrange(32, 0x3000)) for _ in range(120)) for _ in range(n)]


def test_ids_equal_the_library(reference):
    own = byte_bpe.ByteBPE(*vocabulary(byte_bpe.VOCABULARY))
    rows = strange()
    for text, ids in zip(rows, own.encode(rows), strict=True):
        assert ids.tolist() == reference[0].encode_ordinary(text)
        assert own.decode(ids.tolist()) == text.encode()


def test_forgetting_pieces_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    own = byte_bpe.ByteBPE(*vocabulary(byte_bpe.VOCABULARY))
    for text in strange(20):
        assert own.encode([text])[0].tolist() == reference[0].encode_ordinary(text)


def test_counts_equal_the_library(reference):
    rows = ["", *strange()]
    counts = piece_counts.PieceCounter(vocabulary(piece_counts.MODEL)[0]).count(rows)
    assert counts == [len(x) for x in reference[1].encode(rows)]


def test_long_segments_equal_the_library(reference):
    chosen = random.Random(2)
    rows = [base64.b64encode(chosen.randbytes(n)).decode() for n in (1600, 90_000)]
    rows += ["漢é😀z" * 2500, " " * 7001 + "x", "a" * 5001, "".join(chosen.choice("theandofigr▁") for _ in range(40_000))]
    rows.append(f"{rows[1]} and {rows[2]} then {rows[1]}")
    counter = piece_counts.PieceCounter(vocabulary(piece_counts.MODEL)[0])
    assert counter.count(rows) == [len(x) for x in reference[1].encode(rows)]
    # Both forms of the rounds give the same.
    assert counter.segments(rows[2:4]).tolist() == [counter.long_segment(row) for row in rows[2:4]]


def test_an_unbroken_megabyte(reference):
    row = base64.b64encode(random.Random(3).randbytes(750_000)).decode()
    counter = piece_counts.PieceCounter(vocabulary(piece_counts.MODEL)[0])
    start = time.perf_counter()
    assert counter.count([row]) == [len(reference[1].encode(row))]
    assert time.perf_counter() - start < 10


def test_tables(spark, odd, empty, reference):
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    rows = byte_bpe.round_trip(odd).collect()
    assert len(rows) == odd.count()
    for row in rows:
        ids = reference[0].encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    for row in piece_counts.count_tokens(odd, limit=100).collect():
        n = len(reference[1].encode(texts[row.doc_id]))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), n, n > 100)
    assert byte_bpe.round_trip(empty).count() == piece_counts.count_tokens(empty).count() == 0


def test_columns_are_kept(odd):
    coded = byte_bpe.decode(byte_bpe.encode(odd, ids="token"), ids="token", out="score")
    assert set(coded.columns) == set(odd.columns)
    for row in coded.collect():
        assert bytes(row.score) == (row.text or "").encode()
