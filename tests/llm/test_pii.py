"""Personal data: base spans by brute force, and what the field adds."""

import hashlib
import random
import re

import numpy as np
import pytest

from patronage.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(number):
    total = 0
    for k, digit in enumerate(reversed(number)):
        value = int(digit) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def brute(text):
    numbers = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(numbers(m[0])) <= 19 and luhn(numbers(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(numbers(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    chosen = random.Random(2)
    fixed = ["1.2.3.4.5.6.7.8.9", "a@b@c.d.e..f@g.h", "@x.y", "00255.1.1.1", "4111 1111-1111 1111 +49 30 123456 77", "٣٣@x.y +1 ٣"]
    for text in fixed + ["".join(chosen.choice("ab1245.@+- ()") for _ in range(80)) for _ in range(3000)]:
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "+1 " * 50_000, "1." * 50_000):
        pii.base_spans(text)
        pii._runs(text)


@pytest.fixture(scope="module")
def field(spark, small):
    return pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_field_adds_what_runs_together(field):
    text = "so there +1 (578) 555-6437 4918187128635271 and a@b.example the end of it"
    (base, spans), = pii.find_in([text], field, {})
    assert [s[0] for s in base] == ["email"]
    found = {text[a:b]: kind for kind, a, b in spans}
    assert found["a@b.example"] == "email"
    assert len(spans) > len(base)


def test_decoding_equals_all_paths():
    chosen = np.random.default_rng(0)
    field = pii.Field(chosen.normal(size=(pii.FEATURES, len(pii.LABELS))), chosen.normal(size=(len(pii.LABELS),) * 2) + pii.ALLOWED)
    rows = [chosen.integers(0, pii.FEATURES, (n, pii.PER_WORD)) for n in (1, 2, 3, 3, 4)]
    for row, labels in zip(rows, field.decode(rows), strict=True):
        scores = field.emission[row].sum(axis=1)
        best = max(np.ndindex(*[len(pii.LABELS)] * len(row)), key=lambda p: pii.START[p[0]] + sum(scores[i, k] for i, k in enumerate(p)) + sum(field.transition[a, b] for a, b in zip(p, p[1:], strict=False)))
        assert tuple(labels.tolist()) == best


def test_tables(odd, empty, field):
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = pii.digest(odd, field).collect()
    assert len(rows) == odd.count() and pii.digest(empty, field).count() == 0
    for row in rows:
        base = brute(texts[row.doc_id] or "")
        assert row.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
    masked = pii.mask(odd, field)
    assert masked.columns == odd.columns
    for row in masked.collect():
        assert (row.text is None) == (texts[row.doc_id] is None)
        if row.text is not None:
            assert row.n_chars == len(row.text) and not pii.base_spans(row.text)
    assert "pii" in pii.find(odd, field).columns


def test_without_labelled_rows(empty, odd):
    field = pii.fit(empty)
    assert pii.digest(odd, field).count() == odd.count()
