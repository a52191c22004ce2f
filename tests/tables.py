"""Small shop tables for tests, and a brute-force RFM over plain rows."""

from __future__ import annotations

import datetime
from collections import defaultdict
from decimal import Decimal


def make_tables(spark, orders, customers=None):
    """``orders``: (order_id, customer_id, status, 'YYYY-MM-DD[ HH:MM:SS]', n_items, payments).

    A customer id ``u5.b`` belongs to person ``u5``.
    """
    logins = customers or sorted({(c, c.split(".")[0]) for _, c, *_ in orders})
    return {
        "customers": spark.createDataFrame(logins, "customer_id string, customer_unique_id string"),
        "orders": spark.createDataFrame(
            [(o, c, s, datetime.datetime.fromisoformat(t)) for o, c, s, t, _, _ in orders],
            "order_id string, customer_id string, order_status string, "
            "order_purchase_timestamp timestamp_ntz",
        ),
        "order_items": spark.createDataFrame(
            [(o, i) for o, _, _, _, n, _ in orders for i in range(n)],
            "order_id string, order_item_id int",
        ),
        "order_payments": spark.createDataFrame(
            [
                (o, i, None if p is None else Decimal(p))
                for o, _, _, _, _, payments in orders
                for i, p in enumerate(payments)
            ],
            "order_id string, payment_sequential int, payment_value decimal(10,2)",
        ),
    }


def brute_force(orders, churn_days=180, min_orders=2):
    """{person: (recency, frequency, monetary, lifetime, gap, label)} row by row."""
    day = {o: datetime.date.fromisoformat(t[:10]) for o, _, _, t, _, _ in orders}
    delivered = [r for r in orders if r[2] == "delivered"]
    if not delivered:
        return {}
    cutoff = max(day[r[0]] for r in delivered) - datetime.timedelta(days=churn_days)
    rows = defaultdict(set)
    active = set()
    for o, c, _, _, n_items, payments in delivered:
        person = c.split(".")[0]
        if day[o] >= cutoff:
            active.add(person)
        elif n_items:
            rows[person] |= {(day[o], o, p) for p in payments}
    result = {}
    for person, found in rows.items():
        days = sorted(d for d, _, _ in found)
        frequency = len({o for _, o, _ in found})
        if frequency < min_orders:
            continue
        gaps = [(b - a).days for a, b in zip(days, days[1:])]
        known = [Decimal(p) for _, _, p in found if p is not None]
        # Exact rounding, half away from zero.
        gap = ((20 * sum(gaps) + len(gaps)) // (2 * len(gaps))) / 10 if gaps else 0.0
        result[person] = (
            (cutoff - days[-1]).days,
            frequency,
            float(sum(known)) if known else None,
            (days[-1] - days[0]).days,
            gap,
            0 if person in active else 1,
        )
    return result


def as_dict(df):
    columns = [
        "recency_days",
        "frequency",
        "monetary",
        "customer_lifetime_days",
        "avg_days_between_orders",
        "churn_label",
    ]
    return {r["customer_unique_id"]: tuple(r[c] for c in columns) for r in df.collect()}
