"""Runs and model versions, kept as parquet tables beside the models."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from patronage.sources.files import create_exclusive, file_system

RUN_COLUMNS = (
    "run_id string, params map<string,string>, metrics map<string,double>, logged_at timestamp"
)
VERSION_COLUMNS = "version int, run_id string, path string, n_partitions int, registered_at timestamp"


def _rows(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The table at ``path``, of which every writer has a folder of its own; no rows before the first."""
    try:
        found = spark.read.schema(columns).parquet(path)
        return found.drop("writer")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def runs(spark: SparkSession, registry: str) -> DataFrame:
    return _rows(spark, f"{registry}/runs", RUN_COLUMNS)


def versions(spark: SparkSession, registry: str) -> DataFrame:
    return _rows(spark, f"{registry}/versions", VERSION_COLUMNS)


def log_run(
    spark: SparkSession, registry: str, params: dict[str, str], metrics: dict[str, float]
) -> str:
    """Append one run. Undefined metrics (NULL) stay in the map as NULL."""
    run_id = uuid.uuid4().hex
    row = spark.createDataFrame(
        [(run_id, params, metrics)],
        "run_id string, params map<string,string>, metrics map<string,double>",
    )
    row.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.parquet(
        f"{registry}/runs/writer={run_id}"
    )
    return run_id


def latest_run(spark: SparkSession, registry: str) -> DataFrame:
    return runs(spark, registry).orderBy(F.desc("logged_at"), "run_id").limit(1)


def best_run(spark: SparkSession, registry: str, metric: str = "auc") -> DataFrame:
    score = F.col("metrics")[metric]
    return runs(spark, registry).orderBy(F.desc_nulls_last(score), "run_id").limit(1)


def latest_version(spark: SparkSession, registry: str) -> int:
    """The highest registered version, 0 if there is none."""
    top = versions(spark, registry).agg(F.max("version").alias("v")).first()["v"]
    return top or 0


def claim_version(spark: SparkSession, registry: str) -> int:
    """A version that is the caller's alone, above all announced and claimed ones.

    A claim is an empty file that only one caller can make: others find it and try the next
    number. That rests on the file system's exclusive creation (of a local disk, of HDFS, and of object
    stores with conditional writes)."""
    folder = f"{registry}/claims"
    files, make = file_system(spark, folder)
    files.mkdirs(make(folder))
    version = latest_version(spark, registry) + 1
    while not create_exclusive(spark, f"{folder}/version={version}"):
        version += 1
    return version


def register_model(
    spark: SparkSession, registry: str, model: PipelineModel, run_id: str, n_partitions: int | None = None
) -> int:
    """Save the model as the next version, also while others do the same. The row that
    announces a version is appended after its files are complete; a version that was claimed by a
    job that failed is left out."""
    version = claim_version(spark, registry)
    path = f"{registry}/models/version={version}"
    model.save(path)
    row = spark.createDataFrame(
        [(version, run_id, path, n_partitions)], "version int, run_id string, path string, n_partitions int"
    )
    row.withColumn("registered_at", F.current_timestamp()).coalesce(1).write.parquet(
        f"{registry}/versions/writer={version}"
    )
    return version


def load_latest(spark: SparkSession, registry: str) -> tuple[PipelineModel, int]:
    version = latest_version(spark, registry)
    if not version:
        raise LookupError(f"no model registered in {registry}")
    path = versions(spark, registry).where(F.col("version") == version).first()["path"]
    return PipelineModel.load(path), version
