"""Customers in the feature store: one by key, or a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.columns import count_where, unplaced
from patronage.operators.skew import join_on_unique
from patronage.schemas import CUSTOMER_KEY


def lookup_customer(store: DataFrame, customer_id) -> DataFrame:
    """The row of one customer, or no row. The key filter reaches the scan."""
    return store.where(F.col(CUSTOMER_KEY) == F.lit(customer_id)).limit(1)


def request_table(spark: SparkSession, customer_ids: Sequence) -> DataFrame:
    """A short request list as a table (pos, customer_id)."""
    ids = F.array(*(F.lit(c) for c in customer_ids))
    return spark.range(1).select(F.posexplode(ids).alias("pos", "customer_id"))


def requested(store: DataFrame, requests: DataFrame) -> DataFrame:
    """The store rows that a request asks for, each once. Of a bucketed store and the requests
    only the distinct ids of the requests move."""
    asked = requests.select(F.col("customer_id").alias(CUSTOMER_KEY)).distinct()
    return store.join(asked.select(unplaced(CUSTOMER_KEY)), CUSTOMER_KEY, "left_semi")


def answer_requests(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Every request with the columns of its customer and ``found``.

    Repeated ids give repeated rows; unknown ids give NULLs. ``store`` is
    unique by customer. Requests for one customer may be very many, see
    ``join_on_unique``; for that both sides have to move.
    """
    rest = [c for c in store.columns if c != CUSTOMER_KEY]
    known = store.select(unplaced(CUSTOMER_KEY).alias("customer_id"), *rest, F.lit(True).alias("_hit"))
    return (
        join_on_unique(requests, known, "customer_id", "left")
        .withColumn("found", F.col("_hit").isNotNull())
        .drop("_hit")
    )


def batch_summary(answers: DataFrame) -> DataFrame:
    """One row: requests, found and not found; repeated ids count each time."""
    return answers.agg(
        F.count(F.lit(1)).alias("n_requested"),
        count_where(F.col("found")).alias("n_found"),
        count_where(~F.col("found")).alias("n_not_found"),
    )
