"""Exact stratified split and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronage.functions.columns import count_where, hash_order
from patronage.schemas import CUSTOMER_KEY, TARGET

SEED = 42
TEST_SIZE = 0.25
TRAIN, TEST = "train", "test"
#: Hexadecimal digits of the hash by which a pass counts, and passes. After these 48 bits a
#: prefix holds one row as a rule, up to some 10**14 rows.
DIGITS, PASSES = 4, 3


def split_data(
    df: DataFrame,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    key: str = CUSTOMER_KEY,
    label: str = TARGET,
) -> DataFrame:
    """Add ``side``: of every class exactly ``round(test_size * n)`` rows are test.

    Test rows are those with the smallest hash of key and seed, so the split
    depends on neither partitioning nor row order. Only the last test row of
    each class has to be found, not the rank of every row: each pass counts rows by the
    next digits of the hash, within the prefix in which the share was reached by the pass before.
    ``df`` is read once per pass and twice more, and should be a stored table.
    """
    hashed = df.withColumn("_hash", hash_order(key, seed))
    by_prefix = hashed.groupBy(label, F.substring("_hash", 1, DIGITS).alias("_prefix")).agg(F.count(F.lit(1)).alias("n"))
    class_rows = Window.partitionBy(label)
    quota = F.round(F.lit(test_size) * F.sum("n").over(class_rows)).cast("bigint")
    edge = _edge(by_prefix.withColumn("_rank", quota), label)
    for done in range(1, PASSES):
        prefix = F.substring("_hash", 1, done * DIGITS).alias("_prefix")
        # One row per class: the label takes two values by rule.
        rows = hashed.select(label, prefix, "_hash").join(F.broadcast(edge), [label, "_prefix"])
        longer = F.substring("_hash", 1, (done + 1) * DIGITS).alias("_prefix")
        edge = _edge(rows.groupBy(label, "_rank", longer).agg(F.count(F.lit(1)).alias("n")), label)
    ranked = F.row_number().over(class_rows.orderBy("_hash", key))
    last = (
        hashed.select(label, F.substring("_hash", 1, PASSES * DIGITS).alias("_prefix"), "_hash", key)
        .join(F.broadcast(edge), [label, "_prefix"])
        .withColumn("_row", ranked)
        .where(F.col("_row") == F.col("_rank"))
        .select(label, F.struct("_hash", key).alias("_last"))
    )
    is_test = F.struct("_hash", key) <= F.col("_last")
    return (
        hashed.join(F.broadcast(last), label, "left")
        .withColumn("side", F.when(is_test, TEST).otherwise(TRAIN))
        .drop("_hash", "_last")
    )


def _edge(counts: DataFrame, label: str) -> DataFrame:
    """(label, prefix, rank within it) of the prefix that holds the row of rank ``_rank`` (from 1) of each class.

    ``counts`` has at most 16**DIGITS rows per class."""
    upto = F.sum("n").over(Window.partitionBy(label).orderBy("_prefix"))
    held = F.col("_rank").between(F.col("upto") - F.col("n") + 1, F.col("upto"))
    return counts.withColumn("upto", upto).where(held).select(label, "_prefix", (F.col("_rank") - F.col("upto") + F.col("n")).alias("_rank"))


def class_ratio(label: str = TARGET) -> Column:
    """Negatives per positive, as an aggregate; NULL without positives."""
    return F.try_divide(
        count_where(F.col(label) == 0).cast("double"), count_where(F.col(label) == 1)
    )


def class_weights(train: DataFrame, label: str = TARGET) -> DataFrame:
    """One row: class counts of the training side, and their ratio."""
    return train.agg(
        count_where(F.col(label) == 0).alias("n_negative"),
        count_where(F.col(label) == 1).alias("n_positive"),
        F.round(class_ratio(label), 6).alias("scale_pos_weight"),
    )


def add_weight(df: DataFrame, ratio: float, label: str = TARGET) -> DataFrame:
    """Positives weigh ``ratio``, negatives 1."""
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(ratio)).otherwise(1.0))
