"""Batch jobs: ``python -m patronage <step>``, or the same with spark-submit.

    load      raw CSV files -> typed tables
    rfm       tables -> RFM rows with churn label
    features  RFM rows -> feature store
    train     feature store -> model version and run
    score     feature store + request table -> scores
    score-one one customer of the feature store -> its event
    score-stream  request files that have arrived -> scores
    status    feature store and model version
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession

from patronage.operators import profile
from patronage.operators.orders import CHURN_DAYS
from patronage.operators.rfm import top_recent_customers
from patronage.plans import pipeline, registry, scoring, training
from patronage.schemas import CUSTOMER_KEY, RAW_TABLES
from patronage.session import build_session, new_path
from patronage.sources import csv_tables
from patronage.sources.parquet_tables import open_store, read_table, write_table
from patronage.streaming import scoring_stream


def load(spark: SparkSession, args: argparse.Namespace) -> None:
    files = dict(pair.split("=", 1) for pair in args.file)
    csv_tables.load_report(csv_tables.load_all(spark, args.raw, args.tables, files)).show()


def rfm(spark: SparkSession, args: argparse.Namespace) -> None:
    tables = {name: read_table(spark, f"{args.tables}/{name}") for name in RAW_TABLES}
    _report(pipeline.build_rfm_dataset(tables, args.out, args.churn_days))


def features(spark: SparkSession, args: argparse.Namespace) -> None:
    _report(pipeline.build_features(spark, args.rfm, args.out, args.sample_size))


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    result = training.train(spark, args.features, args.registry, args.rounds, n_partitions=args.partitions)
    print(f"version {result.version}, run {result.run_id}: {result.metrics}")


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    model, version = registry.load_latest(spark, args.registry)
    store = open_store(spark, args.features)
    scored = scoring.score_batch(model, store, read_table(spark, args.requests), ordered=False)
    summary = scoring.score_summary(write_table(scored, args.out), version)
    print(scoring.batch_events(summary).first()["event_json"])


def score_one(spark: SparkSession, args: argparse.Namespace) -> None:
    model, version = registry.load_latest(spark, args.registry)
    scored = scoring.score_customer(model, open_store(spark, args.features), args.customer, version)
    scored.show(truncate=False)
    write_table(scoring.score_events(scored), args.out).show(truncate=False)


def score_stream(spark: SparkSession, args: argparse.Namespace) -> None:
    model, version = registry.load_latest(spark, args.registry)
    arriving = scoring_stream.request_stream(spark, args.requests, read_table(spark, args.requests).schema)
    store = open_store(spark, args.features)
    scores = scoring_stream.stored_scores(model, store, new_path(spark, "scores"))
    scoring_stream.score_stream(scores, arriving, args.out, args.state).awaitTermination()
    summary = scoring.score_summary(read_table(spark, args.out), version)
    write_table(scoring.batch_events(summary), args.events).show(truncate=False)


def status(spark: SparkSession, args: argparse.Namespace) -> None:
    version = registry.latest_version(spark, args.registry)
    scoring.store_status(open_store(spark, args.features), version).show()


def _report(stored: DataFrame) -> None:
    """First rows, statistics and classes of a stored table."""
    top_recent_customers(stored).show(truncate=False)
    profile.describe(stored.drop(CUSTOMER_KEY)).show(truncate=False)
    profile.churn_rate(stored).show()
    profile.class_distribution(stored).show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(
        prog="patronage", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter
    )
    top.add_argument("--input-gb", type=float, help="size of the input, to size the shuffles")
    steps = top.add_subparsers(required=True)

    def step(run, *required: str) -> argparse.ArgumentParser:
        sub = steps.add_parser(run.__name__.replace("_", "-"))
        for name in required:
            sub.add_argument(f"--{name}", required=True)
        sub.set_defaults(run=run)
        return sub

    step(load, "raw", "tables").add_argument(
        "--file", action="append", default=[], metavar="TABLE=NAME"
    )
    step(rfm, "tables", "out").add_argument(
        "--churn-days", type=int, default=int(os.environ.get("CHURN_DAYS", CHURN_DAYS))
    )
    step(features, "rfm", "out").add_argument("--sample-size", type=int)
    fitted = step(train, "features", "registry")
    fitted.add_argument("--rounds", type=int, default=training.N_ESTIMATORS)
    fitted.add_argument("--partitions", type=int, default=training.PARTITIONS)
    step(score, "features", "registry", "requests", "out")
    step(score_one, "features", "registry", "customer", "out")
    step(score_stream, "features", "registry", "requests", "out", "state", "events")
    step(status, "features", "registry")
    return top


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    args.run(build_session(input_gb=args.input_gb), args)


if __name__ == "__main__":
    main()
