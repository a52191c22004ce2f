"""Feature rows shared by tests."""

from __future__ import annotations

import math

from patronage.schemas import FEATURE_SCHEMA, RFM_SCHEMA

RFM_ROWS = [
    ("c1", 10, 3, 150.0, 90, 45.0, 0),
    ("c2", 200, 1, 0.0, 0, None, 1),
    ("c3", 50, 5, 400.0, 300, 60.0, 0),
]

STORE_ROWS = [
    ("cust_001", 10, 3, 150.0, math.log1p(150), 50.0, 30.0, 45.0, 90, 0, 0),
    ("cust_002", 200, 5, 400.0, math.log1p(400), 80.0, 60.0, 60.0, 300, 0, 1),
]


def rfm_rows(spark, rows=RFM_ROWS):
    return spark.createDataFrame(rows, RFM_SCHEMA)


def store_rows(spark, rows=STORE_ROWS):
    return spark.createDataFrame(rows, FEATURE_SCHEMA)


def training_rows(spark, n=400):
    """Customers who churn when long unseen, with some exceptions."""
    rows = []
    for i in range(n):
        recency, frequency = (i * 37) % 300, 2 + i % 5
        churned = int(recency > 120) if i % 11 else int(recency <= 120)
        money, life = 10.0 + (i * 13) % 500, (i * 7) % 400
        rows.append(
            (f"c{i:04d}", recency, frequency, money, math.log1p(money), money / frequency,
             life / frequency, float(i % 30), life, 0, churned)
        )
    return spark.createDataFrame(rows, FEATURE_SCHEMA)
