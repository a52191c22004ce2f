"""Engineered feature columns. Each function maps a DataFrame to a new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import is_missing
from patronage.operators.quality import null_counts
from patronage.schemas import FEATURE_COLUMNS, TARGET

CRITICAL_COLUMNS = ["recency_days", "frequency", "monetary", "customer_lifetime_days", TARGET]


def add_monetary_log(df: DataFrame) -> DataFrame:
    """log(1 + monetary), which tames the long right tail."""
    return df.withColumn("monetary_log", F.log1p("monetary"))


def add_avg_order_value(df: DataFrame) -> DataFrame:
    """Spend per order; NULL where there is no order to divide by."""
    return df.withColumn(
        "avg_order_value", F.try_divide(F.col("monetary").cast("double"), F.col("frequency"))
    )


def add_days_per_order(df: DataFrame) -> DataFrame:
    """Lifetime days per order, 0 for customers with a single order."""
    per_order = F.col("customer_lifetime_days").cast("double") / F.col("frequency")
    return df.withColumn("days_per_order", F.when(F.col("frequency") > 1, per_order).otherwise(0.0))


def add_one_time_buyer_flag(df: DataFrame) -> DataFrame:
    one_order = F.coalesce(F.col("frequency") == 1, F.lit(False))
    return df.withColumn("is_one_time_buyer", one_order.cast("int"))


def fill_missing_gaps(df: DataFrame) -> DataFrame:
    """A customer with one order has no gap between orders: 0 by definition."""
    gap = F.when(~is_missing(df, "avg_days_between_orders"), F.col("avg_days_between_orders"))
    return df.withColumn("avg_days_between_orders", F.coalesce(gap, F.lit(0.0)))


def handle_missing_values(df: DataFrame) -> DataFrame:
    """Fill the gap column, and refuse input whose other columns have holes.

    The check is one aggregation over the input, which the caller should have
    on disk. The error names the first bad column in declared order.
    """
    missing = {r["column_name"]: r["n_nulls"] for r in null_counts(df, CRITICAL_COLUMNS).collect()}
    for column in CRITICAL_COLUMNS:
        if missing[column]:
            raise ValueError(f"{missing[column]} rows without {column!r}; correct the RFM step, not this one")
    return fill_missing_gaps(df)


def engineer(df: DataFrame) -> DataFrame:
    """All engineered columns over RFM rows, in the order of the contract.

    One projection with no shuffle: Catalyst merges the steps.
    """
    return (
        df.transform(fill_missing_gaps)
        .transform(add_monetary_log)
        .transform(add_avg_order_value)
        .transform(add_days_per_order)
        .transform(add_one_time_buyer_flag)
        .select(*FEATURE_COLUMNS)
    )
