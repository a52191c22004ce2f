"""The file system that a path belongs to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The file system of ``path``, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def create_exclusive(spark: SparkSession, path: str) -> bool:
    """Make an empty file; False if it exists. Of several callers one gets True."""
    files, make = file_system(spark, path)
    target = make(path)
    if files.getScheme() == "file":  # Hadoop's local file system looks first and makes then
        return bool(spark._jvm.java.io.File(target.toUri().getPath()).createNewFile())
    return bool(files.createNewFile(target))
