"""Typed CSV ingest: declared columns bound by position, loud on bad input."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.operators.quality import enforce_primary_key
from patronage.schemas import PRIMARY_KEYS, RAW_TABLES
from patronage.sources.csv_records import numbered_lines, quote_blocks, records
from patronage.sources.parquet_tables import row_counts, write_table

# What the reader reports for a quoted empty field, which is text and not NULL.
QUOTED_EMPTY = "\u0001quoted-empty\u0001"

READ_OPTIONS = {
    "header": "true",
    "enforceSchema": "true",  # header text is skipped, not matched
    "encoding": "UTF-8",
    "quote": '"',
    "escape": '"',
    "mode": "FAILFAST",
    "emptyValue": QUOTED_EMPTY,
}


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One raw table. A bad number, an overflow or a wrong number of fields
    fails the job; an unquoted empty field is NULL.

    A scan of the lines counts quotes by file block. Without a field that spans lines each
    line is a record for the reader; else lines are put together by ``records``, which
    splits files between tasks as well.
    """
    lines = numbered_lines(spark, path)
    blocks = quote_blocks(lines)
    if blocks.where("n_odd > 0").isEmpty():
        raw = spark.read.schema(schema).options(**READ_OPTIONS).csv(path)
    else:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        parsed = records(lines, blocks).select(F.from_csv("record", fields, READ_OPTIONS).alias("fields"))
        raw = parsed.select("fields.*")
    return raw.select(*(_restore_empty(f) for f in schema.fields))


def _restore_empty(field: T.StructField):
    c = F.col(field.name)
    if isinstance(field.dataType, T.StringType):
        return F.when(c == QUOTED_EMPTY, "").otherwise(c).alias(field.name)
    return c


def load_table(
    spark: SparkSession,
    name: str,
    csv_path: str,
    target: str,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read one CSV table, check its key, replace the stored table, return it.

    The key is checked on the parquet copy, which is cheaper to read than text.
    After a bad field or a repeated key the stored table is what it was.
    """
    df = read_csv_table(spark, csv_path, schema or RAW_TABLES[name])

    def check(stored: DataFrame) -> None:
        if name in PRIMARY_KEYS:
            enforce_primary_key(stored, PRIMARY_KEYS[name], name)

    return write_table(df, f"{target}/{name}", check)


def load_all(
    spark: SparkSession, folder: str, target: str, files: Mapping[str, str] | None = None
) -> dict[str, DataFrame]:
    """All raw tables in declared order. ``files`` names files that differ from
    ``<table>.csv``; a name may be a folder or a pattern of many files."""
    files = files or {}
    return {
        name: load_table(spark, name, f"{folder}/{files.get(name, name + '.csv')}", target)
        for name in RAW_TABLES
    }


def load_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of the loaded tables."""
    return row_counts(tables)
