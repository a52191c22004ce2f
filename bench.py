"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local threads, BENCH_RUNS
how often each query runs (the median counts). Every run writes all result
rows to a sink that drops them, so no column is pruned away and no action is
cheaper than the query. The step that opens the feature store, like the
training, is timed by itself; queries over stored features do not include it.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from patronage.plans import training
from patronage.session import build_session, new_path
from patronage.workload.queries import QUERIES, feature_path

HEADLINE = [
    "rfm_churn",
    "rfm_sql_param",
    "rfm_identity_merge",
    "delivered_before_cutoff",
    "order_gaps",
    "rfm_metrics",
    "rfm_metrics_nowindow",
    "churn_labels",
    "churn_sweep",
    "engineered_features",
    "rfm_violations",
    "pk_violations",
    "describe_features",
    "stratified_split",
    "auc_rank_sum",
    "batch_lookup",
    "load_report",
    "score_batch",
]


def two_step_form(spark, folder):
    """The flagship composed of the separate operators, for comparison."""
    return QUERIES["churn_labels"](spark, folder)


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(query) -> float:
        return median(
            seconds(lambda: query(spark, folder).write.format("noop").mode("overwrite").save())
            for _ in range(runs)
        )

    run(QUERIES["rfm_churn"])  # starts the JIT
    steps = {"build_store": seconds(lambda: feature_path(spark, folder))}
    timed = {name: run(QUERIES[name]) for name in HEADLINE}
    compared = {"rfm_churn_in_steps": run(two_step_form)}
    registry = new_path(spark, "registry")
    trained = {}
    steps["train_100_rounds"] = seconds(
        lambda: trained.update(
            training.train(spark, feature_path(spark, folder), registry).metrics
        )
    )
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "steps": steps,
                "compared": compared,
                "model": trained,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
