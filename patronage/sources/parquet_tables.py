"""Parquet tables: the hand-off between steps, and the feature store."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.operators.quality import enforce_primary_key
from patronage.schemas import CUSTOMER_KEY, FEATURE_COLUMNS
from patronage.sources.buckets import read_buckets, write_buckets
from patronage.sources.files import file_system


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def publish(
    df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, write=None
) -> DataFrame:
    """Replace the table at ``path`` by ``df`` as a whole, or leave it as it was.

    The rows are written beside the table, read back and given to ``check``; only
    then do two renames put them in its place. On any error before that the old table
    is untouched and the new rows are removed.
    """
    spark = df.sparkSession
    files, make = file_system(spark, path)
    parent, _, name = path.rstrip("/").rpartition("/")
    mark = uuid.uuid4().hex
    # Readers of the parent folder skip names that begin with an underscore.
    staged, old = (f"{parent}/_{kind}-{name}-{mark}" for kind in ("staged", "old"))
    try:
        if write:
            write(df, staged)
        else:
            df.write.parquet(staged)
        if check:
            check(read_table(spark, staged, df.schema))
        target = make(path)
        replaced = files.exists(target)
        if replaced and not files.rename(target, make(old)):
            raise OSError(f"{path} cannot be moved away")
        if not files.rename(make(staged), target):
            if replaced:
                files.rename(make(old), target)
            raise OSError(f"{staged} cannot be moved to {path}")
        if replaced:
            files.delete(make(old), True)
    finally:
        files.delete(make(staged), True)
    spark.catalog.refreshByPath(path)
    return read_table(spark, path, df.schema)


def write_table(
    df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """Replace the table at ``path``, making folders, and return it as stored.

    ``check`` sees the new rows before they replace the old ones, and raises if
    they must not."""
    return publish(df, path, check)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), one row per table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


#: A file beside the rows of a store whose customers were found to be unique.
CHECKED = f"_unique-{CUSTOMER_KEY}"


def write_store(
    df: DataFrame, path: str, n_buckets: int | None = None, check: Callable[[DataFrame], None] | None = None
) -> DataFrame:
    """Write the feature store so that requests meet it where it lies.

    Files are hash buckets of the customer: joins by customer move the other side only, and a
    look-up opens one file, in which Bloom filters skip unknown customers. Customers are
    checked to be unique once, here, and that is recorded beside the rows. ``check`` may refuse
    the new rows like that of ``write_table``.
    """
    spark = df.sparkSession

    def write(rows: DataFrame, target: str) -> None:
        write_buckets(rows, target, CUSTOMER_KEY, n_buckets)
        enforce_primary_key(read_table(spark, target, rows.schema), CUSTOMER_KEY, "feature store")
        files, make = file_system(spark, target)
        files.create(make(f"{target}/{CHECKED}")).close()

    publish(df, path, check, write)
    return read_buckets(spark, path, CUSTOMER_KEY)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The feature store: engineered columns, unique by customer.

    A missing path, a missing column or a repeated customer raises. A store of
    ``write_store`` was checked when it was written and is opened without a job; the
    keys of any other are checked here.
    """
    store = read_buckets(spark, path, CUSTOMER_KEY)
    absent = [c for c in FEATURE_COLUMNS if c not in store.columns]
    if absent:
        raise ValueError(f"feature store {path} lacks {', '.join(absent)}")
    files, make = file_system(spark, path)
    if not files.exists(make(f"{path}/{CHECKED}")):
        enforce_primary_key(store, CUSTOMER_KEY, "feature store")
    return store.select(*FEATURE_COLUMNS)
