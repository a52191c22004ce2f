"""Order-level building blocks: the cutoff, the two time windows, the spend.

A feature window (before the cutoff) and a label window (the cutoff day and
later) never share an order, so features cannot leak the label.
"""

from __future__ import annotations

import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.operators.skew import join_on_unique

CHURN_DAYS = 180
DELIVERED = "delivered"

Tables = dict[str, DataFrame]


class Dates(NamedTuple):
    """Both are None when no order was delivered."""

    ref_dt: datetime.date | None
    cutoff_dt: datetime.date | None


def order_day() -> Column:
    return F.col("order_purchase_timestamp").cast("date")


def delivered_orders(orders: DataFrame, status: str = DELIVERED) -> DataFrame:
    return orders.where(F.col("order_status") == status).select(
        "order_id", "customer_id", order_day().alias("order_date")
    )


def reference_dates(
    orders: DataFrame, churn_days: int = CHURN_DAYS, status: str = DELIVERED
) -> DataFrame:
    """One row: the last delivered day, and the cutoff ``churn_days`` before."""
    last = F.max("order_date")
    return delivered_orders(orders, status).agg(
        last.alias("ref_dt"), F.date_sub(last, churn_days).alias("cutoff_dt")
    )


def resolve_dates(
    orders: DataFrame, churn_days: int = CHURN_DAYS, status: str = DELIVERED
) -> Dates:
    """The one row of ``reference_dates`` as Python dates.

    The cutoff then enters the main plan as a literal, which the parquet scan
    uses to skip row groups and partitions. A scalar subquery would not.
    """
    return Dates(*reference_dates(orders, churn_days, status).first())


def before_cutoff(orders: DataFrame, cutoff: datetime.date | None, status: str) -> DataFrame:
    return delivered_orders(orders, status).where(F.col("order_date") < _day(cutoff))


def from_cutoff(orders: DataFrame, cutoff: datetime.date | None, status: str) -> DataFrame:
    return delivered_orders(orders, status).where(F.col("order_date") >= _day(cutoff))


def _day(value: datetime.date | None) -> Column:
    return F.lit(value).cast("date")


def stocked_orders(order_items: DataFrame) -> DataFrame:
    """Orders with an item. Distinct before the shuffle: one row per order and
    map task is moved, however many items an order has."""
    return order_items.select("order_id").distinct()


def order_spend(order_payments: DataFrame) -> DataFrame:
    """Per order: the sum of its distinct payment values and their number.

    Payments move by order *and* value, at most one row per pair and map task,
    and then as partial sums by order. So no order weighs on one task, whatever
    share of the payments it has.
    """
    return (
        order_payments.select("order_id", "payment_value")
        .distinct()
        .groupBy("order_id")
        .agg(F.sum("payment_value").alias("spend"), F.count(F.lit(1)).alias("n_values"))
    )


def delivered_before_cutoff(
    tables: Tables, cutoff: datetime.date | None, status: str = DELIVERED
) -> DataFrame:
    """The feature window as rows (order, customer, day, payment value).

    An order needs an item and a payment to appear. Orders and customers are
    unique by key, so de-duplicating the payments de-duplicates the result.
    """
    window = before_cutoff(tables["orders"], cutoff, status)
    stocked = window.join(stocked_orders(tables["order_items"]), "order_id", "left_semi")
    customers = tables["customers"].select("customer_id", "customer_unique_id")
    known = join_on_unique(stocked, customers, "customer_id")
    paid = tables["order_payments"].select("order_id", "payment_value")
    rows = join_on_unique(paid, known, "order_id", distinct=True)
    return rows.select("order_id", "customer_unique_id", "order_date", "payment_value")


def active_after_cutoff(
    tables: Tables, cutoff: datetime.date | None, status: str = DELIVERED
) -> DataFrame:
    """Customers with a delivered order on or after the cutoff day.

    Items and payments are not asked for here. The orders are reduced to their
    ``customer_id`` before the join, so no busy customer weighs on one task.
    """
    logins = from_cutoff(tables["orders"], cutoff, status).select("customer_id").distinct()
    customers = tables["customers"].select("customer_id", "customer_unique_id")
    return logins.join(customers, "customer_id").select("customer_unique_id").distinct()
