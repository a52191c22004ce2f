"""Summary reports over a feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import is_missing, numeric_columns
from patronage.operators.selection import select_ranks
from patronage.schemas import TARGET

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def churn_rate(df: DataFrame, label: str = TARGET) -> DataFrame:
    return df.agg(
        F.count(label).alias("n_customers"),
        F.sum(label).cast("bigint").alias("n_churned"),
        F.round(F.avg(label), 6).alias("churn_rate"),
    )


def class_distribution(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows per class, the largest class first."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), label)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum of
    each numeric column, one row per column in the given order. Quartiles interpolate linearly.

    An exact quantile aggregate would hold every distinct value of a column in
    one task; here the values at the ranks around each quartile are found by
    radix selection. Nothing runs before the result is used; then ``df``, which should be a
    stored table, is scanned once for the sums, once for the counts and once per digit.
    """
    columns = list(columns or numeric_columns(df))
    if not columns:
        raise ValueError("no numeric column to describe")
    values = {c: F.when(~is_missing(df, c), F.col(c).cast("double")) for c in columns}
    moments = [F.struct(F.lit(i).alias("_order"), F.lit(c).alias("column_name"), *_moments(values[c])) for i, c in enumerate(columns)]
    sums = df.agg(F.array(*moments).alias("all")).select(F.inline("all"))
    counts = df.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.count(v).alias("n")) for c, v in values.items())).alias("all"))
    at = {name: q * (F.col("n") - 1) for name, q in QUARTILES.items()}
    ranks = {f"{name}_{side}": whole(at[name]).cast("bigint").alias(f"{name}_{side}") for name in QUARTILES for side, whole in (("low", F.floor), ("high", F.ceil))}
    wanted = counts.select(F.inline("all")).where("n > 0").select("column_name", *ranks.values())
    found = select_ranks(df, values, wanted, list(ranks))
    # One row per column.
    summary = sums.join(F.broadcast(found), "column_name", "left")
    quartiles = [_between(F.col(f"{name}_low"), F.col(f"{name}_high"), at[name]).alias(name) for name in QUARTILES]
    return summary.orderBy("_order").select("column_name", "n", "mean", "std", "min", *quartiles, "max")


def _moments(v: Column) -> list[Column]:
    return [
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    ]


def _between(low: Column, high: Column, rank: Column) -> Column:
    """The value at a fractional rank. Equal neighbours, infinite ones too, are the value itself."""
    return F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank)))
