"""Session settings and the shared folder for tables written between steps."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from patronage.sources.files import file_system

# Adaptive execution sizes the partitions after each shuffle, and splits the
# oversized ones in joins. Day arithmetic must not depend on where the job runs.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


# Fewer, larger tasks on large inputs: the number of shuffle blocks is the product
# of the tasks on both sides.
MAX_MAP_TASKS = 100_000
SPLIT_MB = 128
SHUFFLE_MB = 512
# Partitions that a shuffle starts with when nothing is known of the input. Adaptive
# execution merges small ones, so a high number costs little.
INITIAL_PARTITIONS = 2000


def sizing(input_gb: float) -> dict[str, str]:
    """Settings for jobs that read about ``input_gb`` gigabytes.

    Adaptive execution merges shuffle partitions that turn out small, but does
    not add any, so their number has to be an upper estimate.
    """
    split_mb = max(SPLIT_MB, math.ceil(input_gb * 1024 / MAX_MAP_TASKS))
    partitions = math.ceil(input_gb * 1024 / SHUFFLE_MB)  # as if all of it were shuffled
    return {
        "spark.sql.files.maxPartitionBytes": f"{split_mb}m",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(max(INITIAL_PARTITIONS, partitions)),
    }


def build_session(
    app_name: str = "patronage", input_gb: float | None = None, **overrides: str
) -> SparkSession:
    sized = sizing(input_gb) if input_gb is not None else {}
    if input_gb is None and "spark.sql.shuffle.partitions" not in overrides and not SparkSession.getActiveSession():
        sized = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(INITIAL_PARTITIONS)}
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **sized, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or else the
    checkpoint folder that the application has set on its context.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="patronage-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def checkpoint_training(spark: SparkSession) -> None:
    """Let iterative training cut its lineage in the shared folder."""
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)


@contextmanager
def checkpointed(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` computed once, in its partitions and their order, without the plan that led to it.

    For rows that iterative training reads in many short jobs: every task of these is sent the
    lineage of its rows. The files lie in the checkpoint folder of the context, so they survive the
    loss of executors, and go at the end of the block.
    """
    stored = df.checkpoint()
    path = stored._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    try:
        yield stored
    finally:
        files, make = file_system(df.sparkSession, path)
        files.delete(make(path), True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/patronage/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a result that later steps read more than once. The table survives the
    loss of executors, and reading it back prunes columns and pushes filters
    down, which a cached or checkpointed RDD would not. It goes when the application ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    files, make = file_system(spark, path)
    files.deleteOnExit(make(path))
    return spark.read.schema(df.schema).parquet(path)
