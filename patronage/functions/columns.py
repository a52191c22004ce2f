"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.DoubleType, T.FloatType)
_NUMERIC = (T.NumericType,)


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL or, for floating point columns, NaN."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, _FLOATING):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def count_where(condition: Column) -> Column:
    """Rows where ``condition`` is true, as bigint; 0 on no rows."""
    return F.count_if(condition)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def rows_from(columns: list[tuple]) -> Column:
    """``inline`` input: an array of structs, one per tuple of columns."""
    return F.array(*(F.struct(*fields) for fields in columns))


def hash_order(key: str, seed: int) -> Column:
    """A shuffle order that depends on key and seed, not on partitioning."""
    return F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))


def unplaced(column: str) -> Column:
    """The same value, by an expression through which the planner sees no partitioning.

    A join by it moves this side, and may then split its large partitions."""
    return F.element_at(F.array(column), 1).alias(column)
