"""Queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patronage.llm import (
    byte_bpe,
    decontaminate,
    hashing_index,
    html_text,
    ngram_join,
    periodic_runs,
    pii,
    piece_counts,
    quality,
    slice_codes,
    suffix_dedup,
    tensor_minhash,
    toxicity,
)
from patronage.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.digest(docs, pii.fit(docs))


def op2_hashing_index(spark: SparkSession, folder: str) -> DataFrame:
    return hashing_index.search_table(spark, folder)


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks_by_document(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.page_texts(table(spark, folder, "pages"))


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return piece_counts.count_tokens(table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, folder, "documents"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op11_slice_codes(spark: SparkSession, folder: str) -> DataFrame:
    return slice_codes.coded_vectors(table(spark, folder, "embeddings"))


def op12_tensor_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return tensor_minhash.near_duplicates(table(spark, folder, "documents"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.run_digests(table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_hashing_index": op2_hashing_index,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_text": op6_html_text,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_quality": op10_quality,
    "op11_slice_codes": op11_slice_codes,
    "op12_tensor_minhash": op12_tensor_minhash,
    "op13_periodic_runs": op13_periodic_runs,
}
