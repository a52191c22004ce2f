"""Parquet folders whose files hold the rows of one hash bucket each.

A join or an aggregation by the key then starts without moving the table, and a look-up by key
opens one file. The number of buckets is kept as the name of an empty file beside the rows, so that a
folder can be opened by any session; the session's catalog gets an entry that points there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from patronage.sources.files import file_system

MARK = "_buckets-"


def write_buckets(df: DataFrame, path: str, key: str, n_buckets: int | None = None) -> None:
    """Write ``df`` to the new folder ``path`` as one sorted file per bucket of ``key``.

    ``n_buckets`` is ``spark.sql.shuffle.partitions`` by default. Row groups have Bloom filters."""
    spark = df.sparkSession
    n = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = f"patronage_{uuid.uuid4().hex}"
    (
        df.repartition(n, key)
        .write.bucketBy(n, key)
        .sortBy(key)
        .format("parquet")
        .option("path", path)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .saveAsTable(entry)
    )
    spark.sql(f"DROP TABLE {entry}")  # the entry only: the files lie outside the warehouse
    files, make = file_system(spark, path)
    files.create(make(f"{path}/{MARK}{n}")).close()


def read_buckets(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The table at ``path``, by its buckets of ``key`` if it was written so."""
    found = spark.read.parquet(path)
    files, make = file_system(spark, path)
    marks = files.globStatus(make(f"{path}/{MARK}*")) or []
    if not marks:
        return found
    n = int(marks[0].getPath().getName().removeprefix(MARK))
    entry = f"patronage_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
    spark.sql(f"CREATE TABLE {entry} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{path}'")
    return spark.table(entry)
