"""Summary statistics against pandas-style definitions computed by numpy."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from patronage.functions.order_key import key_value, with_order_key
from patronage.operators import profile, selection
from rows import RFM_ROWS, rfm_rows


def summary(df, columns=None):
    return {r["column_name"]: r.asDict() for r in profile.describe(df, columns).collect()}


def check(row, values):
    assert row["n"] == len(values)
    assert row["mean"] == pytest.approx(np.mean(values), rel=1e-12)
    assert row["std"] == pytest.approx(np.std(values, ddof=1), rel=1e-9)
    assert (row["min"], row["max"]) == (min(values), max(values))
    quartiles = np.quantile(values, [0.25, 0.5, 0.75])
    assert [row["p25"], row["p50"], row["p75"]] == pytest.approx(list(quartiles), rel=1e-12)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 17, 10_000, 10_001, 10_003, 60_000])
def test_describe_is_exact(spark, n, tmp_path):
    rng = np.random.default_rng(n)
    data = {
        "spread": rng.lognormal(3, 2, n),
        "ties": rng.integers(0, 4, n).astype(float),
        "lumpy": np.where(rng.random(n) < 0.6, 5.0, rng.normal(0, 1, n)),
    }
    import pandas as pd

    path = str(tmp_path / "data")
    spark.createDataFrame(pd.DataFrame(data)).write.parquet(path)
    rows = summary(spark.read.parquet(path))
    for column, values in data.items():
        check(rows[column], list(values))


def test_describe_skips_missing_values(spark):
    df = rfm_rows(spark, [*RFM_ROWS, ("c4", 7, 2, math.nan, 9, 10.0, 1)])
    rows = summary(df)
    check(rows["monetary"], [150.0, 0.0, 400.0])
    check(rows["avg_days_between_orders"], [45.0, 60.0, 10.0])
    check(rows["churn_label"], [0, 1, 0, 1])
    assert "customer_unique_id" not in rows


def test_describe_of_no_rows_and_of_one(spark):
    empty = summary(rfm_rows(spark, []))["monetary"]
    assert empty["n"] == 0 and empty["p50"] is None and empty["mean"] is None
    one = summary(rfm_rows(spark, RFM_ROWS[:1]))["monetary"]
    assert (one["p25"], one["p75"], one["std"]) == (150.0, 150.0, None)


def test_a_million_ties_at_a_quartile(spark, tmp_path):
    """Rows below, a million equal ones across the quartiles, rows above; some far, tiny or infinite."""
    path = str(tmp_path / "data")
    spark.range(1_400_000).selectExpr(
        "CASE WHEN id < 200000 THEN -1.0 / (id + 1) WHEN id < 1200000 THEN 3.5 ELSE 3.5 + pow(10.0, id % 300) END AS v",
        "CASE id % 5 WHEN 0 THEN double('-Infinity') WHEN 1 THEN 5e-324 WHEN 2 THEN 2.5e-310 ELSE double('Infinity') END AS w",
    ).write.parquet(path)
    rows = summary(spark.read.parquet(path))
    assert [rows["v"][q] for q in ("p25", "p50", "p75")] == [3.5] * 3
    assert [rows["w"][q] for q in ("p25", "p50", "p75")] == [5e-324, 2.5e-310, math.inf]


def test_describe_is_lazy_and_merges_counts(spark, tmp_path):
    path = str(tmp_path / "data")
    spark.range(1000).selectExpr("double(id) AS v", "id % 7 AS w").write.parquet(path)
    df = spark.read.parquet(path)
    spark.sparkContext.setJobGroup("lazy", "describe")
    described = profile.describe(df)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    plan = described._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ObjectHashAggregate" not in plan
    assert plan.count("partial_count(1)") == len(selection.SHIFTS)


EDGES = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308, math.inf, -math.inf, 1.0, 0.1]


def test_order_keys(spark):
    chosen = np.random.default_rng(8)
    bits = chosen.integers(0, 2**64, 20_000, dtype=np.uint64).view(np.float64)
    near = 2.0 ** chosen.integers(-1074, 1024, 5000)
    near = np.concatenate([near, np.nextafter(near, 0), np.nextafter(near, np.inf)])
    values = [float(v) for v in np.concatenate([bits[~np.isnan(bits)], near, -near, EDGES])]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    keyed = with_order_key(df.withColumn("own", F.col("v")), "v", "k")
    rows = keyed.select("own", "k", key_value(F.col("k")).alias("back")).collect()
    for v, k, back in rows:
        own = int(np.float64(abs(v)).view(np.int64))
        assert k == (-own if v < 0 else own) and back == v
    missing = spark.createDataFrame([(math.nan,), (None,)], "v double")
    assert [r.k for r in with_order_key(missing, "v", "k").collect()] == [None, None]


def test_selection_of_any_rank(spark, tmp_path):
    values = [float(v) for v in np.random.default_rng(9).normal(0, 1e6, 501).round(3)] + [2.0] * 99
    df = spark.createDataFrame([(v, -v) for v in values], "a double, b double")
    ranks = [0, 1, 250, 299, 300, 599]
    names = [f"r{k}" for k in range(len(ranks))]
    wanted = spark.createDataFrame([("a", *ranks), ("b", *ranks[::-1])], "column_name string, " + ", ".join(f"{n} long" for n in names))
    found = {r[0]: list(r[1:]) for r in selection.select_ranks(df, {"a": F.col("a"), "b": F.col("b")}, wanted, names).collect()}
    assert found["a"] == [sorted(values)[k] for k in ranks]
    assert found["b"] == [sorted(-v for v in values)[k] for k in ranks[::-1]]


def test_churn_rate_and_classes(spark):
    df = rfm_rows(spark)
    assert tuple(profile.churn_rate(df).first()) == (3, 1, 0.333333)
    assert [tuple(r) for r in profile.class_distribution(df).collect()] == [(0, 2), (1, 1)]
