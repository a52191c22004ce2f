"""Running totals over a global order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patronage.session import materialize


def running_totals(df: DataFrame, order_by: str, sums: Sequence[str]) -> DataFrame:
    """Add ``<column>_before`` for each of ``sums``: its total over the rows
    that come earlier by ``order_by``, whose values must be unique.

    The rows are range-partitioned and written with the number of their slice,
    so that the number is data and does not change if a task runs again. Totals
    within a slice come from a window per slice; those of earlier slices from
    one row per slice.
    """
    sliced = materialize(
        df.repartitionByRange(order_by).withColumn("slice", F.spark_partition_id()), "slices"
    )
    earlier = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("slice")
        .agg(*(F.sum(c).alias(c) for c in sums))
        .select("slice", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_offset") for c in sums))
    )
    within = (
        Window.partitionBy("slice").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    # There are at most spark.sql.shuffle.partitions slices.
    return (
        sliced.select(
            "*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_within") for c in sums)
        )
        .join(F.broadcast(offsets), "slice")
        .select(*df.columns, *((F.col(f"{c}_offset") + F.col(f"{c}_within")).alias(f"{c}_before") for c in sums))
    )
