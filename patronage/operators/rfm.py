"""Recency, frequency, monetary and the churn label, one row per customer.

``rfm`` is the form to use. ``order_gaps``, ``rfm_metrics`` and
``churn_labels`` are its steps as separate operators; the tests hold both to
the same result.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.columns import count_where, rows_from
from patronage.operators import orders as O
from patronage.operators.orders import CHURN_DAYS, DELIVERED, Tables

MIN_ORDERS = 2
KEY = "customer_unique_id"


# --- metrics -------------------------------------------------------------------


def _money(total: Column) -> Column:
    return F.round(total, 2).cast("double")


def _days(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def purchase_facts(tables: Tables, cutoff: datetime.date | None, status: str) -> DataFrame:
    """One row per order of the feature window, with its spend.

    Every side is unique by ``order_id`` and already hashed on it when the
    joins start, so the joins add one shuffle (the orders) and cannot skew.
    """
    return (
        O.before_cutoff(tables["orders"], cutoff, status)
        .join(O.stocked_orders(tables["order_items"]), "order_id", "left_semi")
        .join(O.order_spend(tables["order_payments"]), "order_id")
    )


def rfm_metrics_nowindow(
    tables: Tables, cutoff: datetime.date | None, status: str = DELIVERED
) -> DataFrame:
    """RFM metrics by mergeable aggregates alone.

    The gaps between consecutive rows add up to (last day - first day), so
    their mean needs no window: it is that difference over (rows - 1).
    """
    per_login = (
        purchase_facts(tables, cutoff, status).groupBy("customer_id").agg(*_login_totals())
    )
    return _by_person(per_login, tables).agg(*_person_metrics(cutoff))


def _login_totals() -> list[Column]:
    return [
        F.min("order_date").alias("first_day"),
        F.max("order_date").alias("last_day"),
        F.count("order_id").alias("n_orders"),
        F.sum("n_values").alias("n_rows"),
        F.sum("spend").alias("spend"),
    ]


def _by_person(per_login: DataFrame, tables: Tables):
    """Group per ``customer_id`` totals by person. Totals are merged once per
    ``customer_id`` before the join, so the join is one row to one row."""
    customers = tables["customers"].select("customer_id", KEY)
    return per_login.join(customers, "customer_id").groupBy(KEY)


def _person_metrics(cutoff: datetime.date | None) -> list[Column]:
    first, last = F.min("first_day"), F.max("last_day")
    n_gaps = F.sum("n_rows") - 1
    return [
        _days(F.lit(cutoff).cast("date"), last).alias("recency_days"),
        F.sum("n_orders").cast("bigint").alias("frequency"),
        _money(F.sum("spend")).alias("monetary"),
        _days(last, first).alias("customer_lifetime_days"),
        F.round(F.try_divide(_days(last, first).cast("double"), n_gaps), 1).alias(
            "avg_days_between_orders"
        ),
    ]


def order_gaps(rows: DataFrame) -> DataFrame:
    """Days since the customer's previous row, NULL on the first.

    Rows of one day follow each other with gap 0, and only the first of them
    looks back to an earlier day. The window therefore runs over one row per
    customer and *day*: its groups cannot outgrow the calendar, whatever share
    of the rows a customer has. That first row is then found by its order,
    on which the rows are hashed already.
    """
    days = rows.groupBy(KEY, "order_date").agg(
        F.min(F.struct("order_id", "payment_value")).alias("opener")
    )
    earlier = F.lag("order_date").over(Window.partitionBy(KEY).orderBy("order_date"))
    # An order has one customer and one day, so it opens at most one day.
    openers = days.select(
        F.col("opener.order_id").alias("order_id"),
        F.col("opener.payment_value").alias("opener_value"),
        F.datediff("order_date", earlier).alias("gap"),
        F.lit(True).alias("opens"),
    )
    opens = F.col("opens") & F.col("payment_value").eqNullSafe(F.col("opener_value"))
    gap = F.when(opens, F.col("gap")).otherwise(0).cast("bigint")
    return rows.join(openers, "order_id", "left").select(
        KEY, "order_id", "order_date", "payment_value", gap.alias("days_since_previous_order")
    )


def rfm_metrics(gaps: DataFrame, cutoff: datetime.date | None) -> DataFrame:
    """RFM metrics from rows that carry their gap."""
    return gaps.groupBy(KEY).agg(
        _days(F.lit(cutoff).cast("date"), F.max("order_date")).alias("recency_days"),
        F.countDistinct("order_id").alias("frequency"),
        _money(F.sum("payment_value")).alias("monetary"),
        _days(F.max("order_date"), F.min("order_date")).alias("customer_lifetime_days"),
        F.round(F.avg("days_since_previous_order"), 1).alias("avg_days_between_orders"),
    )


# --- label ---------------------------------------------------------------------


def churn_labels(metrics: DataFrame, active: DataFrame, impute: bool = True) -> DataFrame:
    """Label 1 for customers of the feature window who did not come back.

    ``impute=False`` leaves the mean gap of customers with one row NULL."""
    back = active.withColumn("came_back", F.lit(True))
    churned = F.when(F.col("came_back").isNull(), 1).otherwise(0)
    gap = F.coalesce("avg_days_between_orders", F.lit(0.0)) if impute else F.col("avg_days_between_orders")
    return (
        metrics.join(back, KEY, "left")
        .withColumn("avg_days_between_orders", gap)
        .withColumn("churn_label", churned.cast("int"))
        .drop("came_back")
    )


def churned_customers(metrics: DataFrame, active: DataFrame) -> DataFrame:
    return metrics.join(active, KEY, "left_anti")


def retained_customers(metrics: DataFrame, active: DataFrame) -> DataFrame:
    return metrics.join(active, KEY, "left_semi")


# --- the whole query -------------------------------------------------------------


def customer_rfm(
    tables: Tables, cutoff: datetime.date | None, status: str = DELIVERED
) -> DataFrame:
    """Every customer of the feature window, labelled, one-order ones included.

    Feature-window orders and label-window customers meet in one aggregation
    per ``customer_id`` instead of in a second join with the customers: the
    label side adds a flag to totals that are merged anyway.
    """
    bought = purchase_facts(tables, cutoff, status).select(
        "customer_id", "order_id", "order_date", "n_values", "spend"
    )
    came_back = (
        O.from_cutoff(tables["orders"], cutoff, status)
        .select("customer_id", F.lit(True).alias("came_back"))
    )
    per_login = (
        bought.unionByName(came_back, allowMissingColumns=True)
        .groupBy("customer_id")
        .agg(*_login_totals(), F.max("came_back").alias("came_back"))
    )
    # NULL is a group, but as a key it matches nobody in the label window.
    active = F.coalesce(F.max("came_back"), F.lit(False)) & F.col(KEY).isNotNull()
    return (
        _by_person(per_login, tables)
        .agg(*_person_metrics(cutoff), active.alias("active"))
        .where(F.col("frequency") > 0)
        .select(
            KEY,
            "recency_days",
            "frequency",
            "monetary",
            "customer_lifetime_days",
            F.coalesce("avg_days_between_orders", F.lit(0.0)).alias("avg_days_between_orders"),
            F.when(F.col("active"), 0).otherwise(1).alias("churn_label"),
        )
    )


def rfm(
    tables: Tables,
    churn_days: int = CHURN_DAYS,
    status: str = DELIVERED,
    min_orders: int = MIN_ORDERS,
    cutoff: datetime.date | None = None,
    ordered: bool = True,
) -> DataFrame:
    """RFM and churn label of customers with at least ``min_orders`` orders.

    ``ordered=False`` leaves out the final sort, for steps that do not need it.
    """
    if cutoff is None:
        cutoff = O.resolve_dates(tables["orders"], churn_days, status).cutoff_dt
    result = customer_rfm(tables, cutoff, status).where(F.col("frequency") >= min_orders)
    return result.orderBy("recency_days", KEY) if ordered else result


def top_recent_customers(labelled: DataFrame, n: int = 10) -> DataFrame:
    return labelled.orderBy("recency_days", KEY).limit(n)


# --- threshold sweep -------------------------------------------------------------


def churn_sweep(
    tables: Tables,
    days: Sequence[int],
    status: str = DELIVERED,
    min_orders: int = MIN_ORDERS,
) -> DataFrame:
    """Repeat customers, churners and churn rate for several thresholds.

    The orders are joined and aggregated once: each threshold is a pair of
    conditional aggregates, not a run of the query.
    """
    ref = O.resolve_dates(tables["orders"], 0, status).ref_dt
    cutoffs = {n: F.date_sub(F.lit(ref).cast("date"), n) for n in days}

    paid = tables["order_payments"].select("order_id").distinct()
    complete = (
        O.stocked_orders(tables["order_items"])
        .join(paid, "order_id")
        .withColumn("complete", F.lit(True))
    )
    per_login = (
        O.delivered_orders(tables["orders"], status)
        .join(complete, "order_id", "left")
        .groupBy("customer_id")
        .agg(
            *(count_where(F.col("complete") & (F.col("order_date") < c)).alias(f"n_{n}") for n, c in cutoffs.items()),
            F.max("order_date").alias("last_day"),
        )
    )
    last_day = F.when(F.col(KEY).isNotNull(), F.max("last_day"))
    per_person = _by_person(per_login, tables).agg(
        *(F.sum(f"n_{n}").alias(f"n_{n}") for n in days), last_day.alias("last_day")
    )
    repeat = {n: F.col(f"n_{n}") >= min_orders for n in days}
    gone = {n: F.coalesce(F.col("last_day") < c, F.lit(True)) for n, c in cutoffs.items()}
    totals = per_person.agg(
        *(count_where(repeat[n]).alias(f"customers_{n}") for n in days),
        *(count_where(repeat[n] & gone[n]).alias(f"churners_{n}") for n in days),
    )
    lines = [
        (
            F.lit(n).alias("churn_days"),
            F.col(f"customers_{n}").alias("n_customers"),
            F.col(f"churners_{n}").alias("n_churners"),
        )
        for n in days
    ]
    return totals.select(F.inline(rows_from(lines))).withColumn(
        "churn_rate",
        F.round(F.try_divide(F.col("n_churners").cast("double"), F.col("n_customers")), 6),
    )
