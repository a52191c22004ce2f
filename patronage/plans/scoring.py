"""Churn scores for one customer, a table of requests, or the whole store."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators.lookup import answer_requests, batch_summary, lookup_customer, requested
from patronage.plans.training import predict
from patronage.schemas import CUSTOMER_KEY

SCORES = ["churn_probability", "churn_prediction"]


def score_store(model: PipelineModel, store: DataFrame) -> DataFrame:
    """Key and scores of every row of ``store``."""
    return predict(model, store).select(CUSTOMER_KEY, *SCORES)


def score_customer(
    model: PipelineModel, store: DataFrame, customer_id, version: int | str
) -> DataFrame:
    """One row for one customer. An unknown id raises ``LookupError``."""
    if lookup_customer(store, customer_id).isEmpty():
        raise LookupError(f"customer {customer_id!r} is not in the feature store")
    return score_if_known(model, store, customer_id, version)


def score_if_known(
    model: PipelineModel, store: DataFrame, customer_id, version: int | str
) -> DataFrame:
    """The row of ``score_customer``, or no row for an unknown id."""
    return score_store(model, lookup_customer(store, customer_id)).select(
        F.col(CUSTOMER_KEY).alias("customer_id"),
        *SCORES,
        F.lit(str(version)).alias("model_version"),
    )


def score_batch(
    model: PipelineModel,
    store: DataFrame,
    requests: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """A score row for every request (pos, customer_id), in request order.

    Only the customers asked for are scored, each once; the scores are then
    joined to the requests. Unknown ids get ``found = false`` and NULL scores.
    """
    scores = score_store(model, requested(store, requests))
    answers = answer_requests(requests, scores).select("pos", "customer_id", *SCORES, "found")
    return answers.orderBy("pos") if ordered else answers


def score_summary(scored: DataFrame, version: int | str) -> DataFrame:
    return batch_summary(scored).withColumn("model_version", F.lit(str(version)))


def store_status(store: DataFrame, version: int | str) -> DataFrame:
    return store.agg(
        F.lit("ok").alias("status"),
        F.lit(str(version)).alias("model_version"),
        F.count(F.lit(1)).alias("n_customers_in_store"),
    )


# --- events ----------------------------------------------------------------------


def _event(name: str, *fields) -> Column:
    # Without the option, fields that are NULL would be left out.
    return F.to_json(
        F.struct(F.lit(name).alias("event"), *fields), {"ignoreNullFields": "false"}
    ).alias("event_json")


def score_events(scored: DataFrame) -> DataFrame:
    """One JSON line per score of ``score_customer``."""
    return scored.select(_event("predict", "customer_id", *SCORES, "model_version"))


def batch_events(summary: DataFrame) -> DataFrame:
    """One JSON line per batch, from ``score_summary``."""
    counts = ["n_requested", "n_found", "n_not_found"]
    return summary.select(_event("batch_predict", *counts, "model_version"))
