"""Scores for request files as they arrive."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from patronage.plans.scoring import SCORES, score_store
from patronage.schemas import CUSTOMER_KEY
from patronage.sources.buckets import read_buckets, write_buckets


def request_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files of requests (pos, customer_id) that land in ``folder``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def files_for_batches(spark: SparkSession, folder: str, n_batches: int) -> int:
    """How many files a trigger takes so that those of ``folder`` make at most ``n_batches`` micro-batches.

    Each micro-batch reads the stored scores once, whatever the number of its requests."""
    return max(1, -(-len(spark.read.parquet(folder).inputFiles()) // n_batches))


def stored_scores(
    model: PipelineModel, store: DataFrame, path: str, n_buckets: int | None = None
) -> DataFrame:
    """Score every customer of the store once, into the new folder ``path``, by buckets of the customer."""
    write_buckets(score_store(model, store), path, CUSTOMER_KEY, n_buckets)
    return read_buckets(store.sparkSession, path, CUSTOMER_KEY)


def answers(scores: DataFrame, requests: DataFrame) -> DataFrame:
    """Every request with its customer's scores and ``found``; a stream if ``requests`` is one.

    Of bucketed scores and the requests only the requests move."""
    known = scores.select(F.col(CUSTOMER_KEY).alias("customer_id"), *SCORES, F.lit(True).alias("_hit"))
    joined = requests.select("pos", "customer_id").join(known, "customer_id", "left")
    return joined.select("pos", "customer_id", *SCORES, F.col("_hit").isNotNull().alias("found"))


def score_stream(scores: DataFrame, requests: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Answer all requests that have arrived, then stop.

    ``scores`` is what ``stored_scores`` wrote. The file sink lists the files of each batch
    in a log beside them, once, when the batch is complete: readers of ``output`` see whole
    batches only, and a batch that is repeated after a failure is neither lost nor there
    twice. The checkpoint makes a restarted job go on where the last one ended.
    """
    return (
        answers(scores, requests)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
