"""64-bit integers in the order of doubles, and back, by exact arithmetic in the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MANTISSA = 1 << 52
_INFINITE = 2047 * _MANTISSA


def with_order_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """Replace the double column ``value`` by ``key``: its bits as a bigint, negated for negative values.

    Keys are ordered as the values are; both zeros have key 0, and infinities the outermost
    keys. NULL stays NULL; NaN has no place in the order and gives NULL.

    Intermediate results are columns, since each is used more than once by the next."""
    v, size, guess, quotient = F.col(value), F.col("_size"), F.col("_guess"), F.col("_quotient")
    steps = df.withColumn("_size", F.abs(v))
    usual = (size >= 2.0**-1022) & (size < float("inf"))
    steps = steps.withColumn("_usual", F.when(usual, size).otherwise(1.0))
    # log2 rounds, so its floor may be one off, which the quotient in [0.5, 4) tells. All divisions are by powers of two.
    steps = steps.withColumn("_guess", F.least(F.floor(F.log2("_usual")).cast("double"), F.lit(1023.0)))
    steps = steps.withColumn("_quotient", F.col("_usual") / F.pow(F.lit(2.0), guess))
    off = F.when(quotient >= 2, 1.0).when(quotient < 1, -1.0).otherwise(0.0)
    mantissa = F.when(quotient >= 2, quotient / 2).when(quotient < 1, quotient * 2).otherwise(quotient)
    bits = (guess + off + 1022).cast("bigint") * _MANTISSA + (mantissa * float(_MANTISSA)).cast("bigint")
    steps = steps.withColumn(
        "_bits",
        F.when(size == float("inf"), F.lit(_INFINITE))
        .when(usual, bits)
        .otherwise((F.when(size < 2.0**-1022, size).otherwise(0.0) * 2.0**537 * 2.0**537).cast("bigint")),
    )
    steps = steps.withColumn(key, F.when(v.isNull() | F.isnan(v), None).when(v < 0, -F.col("_bits")).otherwise(F.col("_bits")))
    return steps.drop(value, "_size", "_usual", "_guess", "_quotient", "_bits")


def key_value(key: Column) -> Column:
    """The double whose key this is."""
    size = F.abs(key)
    exponent, fraction = F.shiftright(size, 52), size % _MANTISSA
    value = (
        F.when(exponent == 2047, F.lit(float("inf")))
        .when(exponent == 0, fraction.cast("double") * F.lit(2.0**-1074))
        .otherwise((1 + fraction / float(_MANTISSA)) * F.pow(F.lit(2.0), exponent.cast("double") - 1023))
    )
    return F.when(key < 0, -value).otherwise(value)
