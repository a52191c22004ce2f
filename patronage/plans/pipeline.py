"""The batch steps from raw tables to a stored feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patronage.functions.features import engineer, handle_missing_values
from patronage.operators import rfm as R
from patronage.operators.orders import CHURN_DAYS, DELIVERED, Tables
from patronage.operators.quality import validate_schema, watch_features, watch_rfm
from patronage.sources.parquet_tables import read_table, write_store, write_table


def build_rfm_dataset(
    tables: Tables,
    output_path: str,
    churn_days: int = CHURN_DAYS,
    status: str = DELIVERED,
    min_orders: int = R.MIN_ORDERS,
) -> DataFrame:
    """RFM rows from raw tables, validated and stored.

    Rules are counted as the rows are written, so the joins run once and only the
    key is read again. Rows that fail them replace nothing, and the error stops the caller.
    """
    rows = R.rfm(tables, churn_days, status, min_orders, ordered=False)
    watch = watch_rfm(rows)
    return write_table(watch.on(rows), output_path, watch.enforce)


def build_features(
    spark: SparkSession, input_path: str, output_path: str, sample_size: int | None = None
) -> DataFrame:
    """Stored RFM rows to the stored feature table; every row is kept.

    All rows are validated, as they are written, unless ``sample_size`` asks for a
    seeded sample.
    """
    rfm_rows = read_table(spark, input_path)
    features = engineer(handle_missing_values(rfm_rows))
    if sample_size is not None:
        validate_schema(features, sample_size)
        return write_store(features, output_path)
    watch = watch_features(features)
    return write_store(watch.on(features), output_path, check=watch.enforce)
