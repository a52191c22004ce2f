"""Exact order statistics of many columns at once, by radix selection.

Values become 64-bit keys in their order. A pass counts, per column and prefix of the key
that a wanted rank has led to so far, the rows by the next digit; the running sum of these
counts tells the digit in which each rank lies and the rank within it. After all digits the
prefix is the key of the value itself, whatever the number of rows, ties or spread.

Counts merge before they move, and there are at most 2**DIGIT per column and rank, whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.order_key import key_value, with_order_key

DIGIT = 16
#: Shifts that leave one digit more each.
SHIFTS = (48, 32, 16, 0)


def _narrowed(keys: DataFrame, wanted: DataFrame, names: Sequence[str], shift: int, first: bool) -> DataFrame:
    """``wanted`` (column_name, prefix, a rank within the prefix per name) after one more digit."""
    here = F.shiftright("key", shift)
    rows = keys.select("column_name", here.alias("digit"), F.lit(0).cast("bigint").alias("prefix") if first else F.shiftright(here, DIGIT).alias("prefix"))
    # At most a row per column and name.
    counts = (
        rows.join(F.broadcast(wanted), ["column_name", "prefix"])
        .groupBy("column_name", "prefix", *names, "digit")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(
        Window.partitionBy("column_name", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = counts.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n"))
    held = [F.when((F.col("before") <= F.col(name)) & (F.col(name) < F.col("upto")), F.col(name) - F.col("before")).alias(name) for name in names]
    found = counts.select("column_name", F.col("digit").alias("prefix"), *held)
    return found.where(F.coalesce(*names).isNotNull())


def select_ranks(df: DataFrame, values: dict[str, Column], wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column_name, a double per name): the values at the ranks that ``wanted`` asks for.

    ``values`` gives a double per column name, NULL or NaN where it does not count. ``wanted`` has
    column_name and per name a rank from 0, below the number of values of the column. ``df`` is
    scanned once per digit and should be a stored table."""
    long = df.select(*(value.alias(name) for name, value in values.items())).unpivot([], list(values), "column_name", "value")
    keys = with_order_key(long.where("value IS NOT NULL AND NOT isnan(value)"), "value", "key")
    found = wanted.select("column_name", F.lit(0).cast("bigint").alias("prefix"), *names)
    for k, shift in enumerate(SHIFTS):
        found = _narrowed(keys, found, names, shift, first=k == 0)
    value = key_value(F.col("prefix"))
    return found.groupBy("column_name").agg(*(F.max(F.when(F.col(name).isNotNull(), value)).alias(name) for name in names))
