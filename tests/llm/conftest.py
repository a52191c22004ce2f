import random

import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use inside."""
    chosen = random.Random(3)
    texts = [None, "", " \n ", "one two", "one two", "One  TWO\tthree four five six", LONG, "é漢😀 " * 40, "a" * 3000, "don't  <|endoftext|>\x00\n\n "]
    texts += ["".join(chosen.choice("ab c.@1+-\n") for _ in range(300)) for _ in range(6)]
    rows = [(i, text, None if i % 4 == 0 else "en", f"src{i % 3}", None if text is None else len(text), i, "x", 1.5) for i, text in enumerate(texts)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token long, class string, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
