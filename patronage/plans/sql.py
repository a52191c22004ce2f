"""SQL text from a file, run with bound parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from patronage.operators.orders import CHURN_DAYS, DELIVERED, Tables, resolve_dates
from patronage.operators.rfm import MIN_ORDERS

RFM_QUERY = Path(__file__).with_name("rfm_query.sql")


def load_query(path: str | Path) -> str:
    path = Path(path)
    if not path.is_file():
        raise FileNotFoundError(f"no SQL file at {path}")
    return path.read_text(encoding="utf-8")


def compute_rfm(
    tables: Tables,
    churn_days: int = CHURN_DAYS,
    status: str = DELIVERED,
    min_orders: int = MIN_ORDERS,
    path: str | Path = RFM_QUERY,
) -> DataFrame:
    """The RFM query as SQL. Values are bound by name, never put into the text, and
    tables are given to the query, so that no view of the session is replaced.

    The cutoff is resolved first: bound as a date, it prunes what the scans read.
    """
    spark = tables["orders"].sparkSession
    names = ("orders", "customers", "order_items", "order_payments")
    cutoff = resolve_dates(tables["orders"], churn_days, status).cutoff_dt
    args = {"cutoff": cutoff, "status": status, "min_orders": min_orders}
    return spark.sql(load_query(path), args=args, **{name: tables[name] for name in names})
