"""The stages against the operators they call, and the rows of the whole."""

import corpus_pipeline
from patronage.llm import decontaminate, pii, toxicity
from test_near_duplicates import brute, large_between_short


def test_stages_on_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))

    kept = stages["toxicity"](spark, docs, small)
    scores = {r.doc_id: r.score for r in toxicity.classify(docs, toxicity.fit(docs, labels)).collect()}
    assert kept.columns == docs.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {key for key, score in scores.items() if score < toxicity.THRESHOLD}

    single = stages["ngram_join"](spark, kept, small)
    groups = brute([(r.doc_id, r.text) for r in rows.values()])
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in groups})

    clean = stages["decontamination"](spark, single, small)
    leaks = {r.doc_id for r in decontaminate.leaks_by_document(single, items).collect() if r.contaminated}
    assert {r.doc_id for r in clean.collect()} == {c for _, _, c in groups} - leaks

    masked = stages["pii"](spark, clean, small)
    assert masked.columns == docs.columns
    for row in masked.collect():
        assert not pii.base_spans(row.text) and row.n_chars == len(row.text)

    tokens = stages["byte_bpe"](spark, masked, small).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in tokens)
    assert {r.doc_id for r in tokens} == {r.doc_id for r in clean.collect()}


def test_large_text_between_short_ones(spark, small):
    item = " ".join(f"passage{k}" for k in range(40))
    stages = dict(corpus_pipeline.STAGES)
    rows = large_between_short(item)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    single = stages["ngram_join"](spark, docs, small)
    assert {r.doc_id for r in single.collect()} == {c for _, _, c in brute(rows)}
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.remove_contaminated(single, items).collect()} == {1, 2, 5, 7}


def test_odd_tables(spark, odd, empty, small):
    columns = "doc_id", "text", "lang", "source", "n_chars"
    for docs in (odd.select(*columns), odd, empty):
        out = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, small)
            assert out.columns == docs.columns
        coded = corpus_pipeline.STAGES[-1][1](spark, out, small).collect()
        assert all(r.round_trip for r in coded) and bool(coded) == bool(docs.head(1))
