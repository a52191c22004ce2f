import numpy as np
import pytest

from patronage.llm import quality

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    return quality.fit(docs, labels), docs, labels


def test_held_out_accuracy(fitted):
    model, docs, labels = fitted
    rows = quality.score(docs, model).filter("held_out").join(labels, "doc_id").collect()
    good = [r.score for r in rows if r.quality]
    poor = [r.score for r in rows if not r.quality]
    assert np.mean([[(a > b) + 0.5 * (a == b) for b in poor] for a in good]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_views_teach_each_other():
    """One view has labels enough, the other learns from its verdicts on the pool."""
    chosen = np.random.default_rng(0)
    y = (chosen.random(4000) < 0.5).astype(float)
    strong = np.column_stack([y + 0.1 * chosen.normal(size=4000), np.ones(4000)])
    weak = np.column_stack([y[:, None] + 1.5 * chosen.normal(size=(4000, 12))])
    few = slice(0, 24)
    alone = quality.fit_linear(weak[few], y[few])
    taught = quality.co_train((strong[few], weak[few]), y[few], (strong[24:3000], weak[24:3000]))[1]
    right = lambda model: ((model.logits(weak[3000:]) > 0) == (y[3000:] > 0)).mean()
    assert right(taught) > right(alone)


def test_tables(fitted, odd, empty):
    model = fitted[0]
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(empty, model).count() == 0


def test_one_class_only(spark, odd):
    labels = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels)).collect()} == {1.0}
    assert {r.score for r in quality.score(odd, quality.fit(odd, labels.limit(0))).collect()} == {0.0}
