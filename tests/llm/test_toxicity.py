import pytest

from patronage.llm import toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(docs, labels), docs, labels


def test_held_out_accuracy(fitted):
    model, docs, labels = fitted
    rows = toxicity.classify(docs, model).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    above = sum((a.score > b.score) + 0.5 * (a.score == b.score) for a in toxic for b in clean)
    assert above / (len(toxic) * len(clean)) > 0.93
    assert sum(r.predicted for r in toxic) > 0.7 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.02 * len(clean)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_tables(fitted, odd, empty):
    model = fitted[0]
    rows = toxicity.classify(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.classify(empty, model).count() == 0
    assert set(toxicity.score(odd, model).columns) == {*odd.columns, "toxicity"}
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1


def test_one_class_only(spark, odd):
    labels = spark.createDataFrame([(i, 0) for i in range(9)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    assert {r.score for r in toxicity.classify(odd, model).collect()} == {0.0}
    assert toxicity.fit(odd, labels.limit(0)).weights == ()


def test_windows_cover_the_text():
    text = b"A b " * 40 + b"c" * 2000
    assert b"".join(toxicity.windows(text)).replace(b" ", b"") == text.lower().replace(b" ", b"")
