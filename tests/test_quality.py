"""Rules report every breach, and enforcing them raises."""

import math

import pytest

from patronage.functions.features import engineer
from patronage.operators import quality as Q
from patronage.sources.parquet_tables import write_table
from rows import RFM_ROWS, rfm_rows, store_rows

GOOD = [("c1", 10, 3, 150.0, 90, 45.0, 0), ("c2", 0, 1, 0.0, 0, 0.0, 1)]


def broken(df, rules):
    return {r["rule"]: r["n_violations"] for r in Q.check(df, rules).collect() if r["n_violations"]}


def test_good_rows_pass(spark):
    df = rfm_rows(spark, GOOD)
    Q.validate_rfm(df)
    Q.validate_raw(df)
    Q.validate_schema(engineer(df))
    Q.validate_schema(engineer(df), sample_size=1)


@pytest.mark.parametrize(
    ("row", "rule"),
    [
        (("c1", 1, 1, 1.0, 0, 0.0, 0), "customer_unique_id is unique"),
        (("c9", None, 1, 1.0, 0, 0.0, 0), "recency_days is present"),
        (("c9", 1, None, 1.0, 0, 0.0, 0), "frequency is present"),
        (("c9", 1, 1, math.nan, 0, 0.0, 0), "monetary is present"),
        (("c9", 1, 1, 1.0, 0, 0.0, None), "churn_label is present"),
        (("c9", 1, 1, 1.0, 0, 0.0, 2), "churn_label in (0, 1)"),
        (("c9", 1, 0, 1.0, 0, 0.0, 0), "frequency >= 1"),
        (("c9", 1, 1, -0.01, 0, 0.0, 0), "monetary >= 0"),
        (("c9", -1, 1, 1.0, 0, 0.0, 0), "recency_days >= 0"),
    ],
)
def test_each_rfm_rule(spark, row, rule):
    df = rfm_rows(spark, [*GOOD, row])
    assert broken(df, Q.rfm_rules(df)) == {rule: 1}
    with pytest.raises(Q.QualityError) as caught:
        Q.validate_rfm(df)
    assert f"{rule}: 1 rows" in str(caught.value)


def test_missing_key_counts_as_duplicate(spark):
    df = rfm_rows(spark, [*GOOD, (None, 1, 1, 1.0, 0, 0.0, 0)])
    assert broken(df, Q.rfm_rules(df)) == {"customer_unique_id is unique": 1}


def test_watched_rows_are_refused_like_checked_ones(spark, tmp_path):
    bad = [("c1", -1, 0, -1.0, 0, 0.0, 3), ("c1", 1, 1, 1.0, 0, 0.0, 0), (None, 1, 1, math.nan, 0, 0.0, None)]
    df = rfm_rows(spark, [*GOOD, *bad])
    with pytest.raises(Q.QualityError) as checked:
        Q.validate_rfm(df)
    watch = Q.watch_rfm(df)
    with pytest.raises(Q.QualityError) as watched:
        write_table(watch.on(df), str(tmp_path / "rows"), watch.enforce)
    assert str(watched.value) == str(checked.value)
    assert not (tmp_path / "rows").exists()
    for k, rows in enumerate((GOOD, [])):
        watch = Q.watch_rfm(df)
        assert write_table(watch.on(rfm_rows(spark, rows)), str(tmp_path / f"good{k}"), watch.enforce).count() == len(rows)


def test_stored_rows_are_read_for_their_key_only(spark, tmp_path, monkeypatch):
    read, df = [], rfm_rows(spark, GOOD)
    counted = Q._violations
    monkeypatch.setattr(Q, "_violations", lambda stored, rules: read.append([r.name for r in rules]) or counted(stored, rules))
    watch = Q.watch_rfm(df)
    write_table(watch.on(df), str(tmp_path / "rows"), watch.enforce)
    assert read == [["customer_unique_id is unique"]]
    stored = spark.read.parquet(str(tmp_path / "rows"))
    plan = Q.check(stored, watch.keys)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<customer_unique_id:string>" in plan


def test_all_breaches_are_listed(spark):
    df = rfm_rows(spark, [("c1", -1, 0, -1.0, 0, 0.0, 3)])
    with pytest.raises(Q.QualityError, match="breaks 4 rules"):
        Q.validate_rfm(df)


@pytest.mark.parametrize(
    ("row", "rule"),
    [
        (("c9", 1, 1, 1.0, -1, 0.0, 0), "customer_lifetime_days >= 0"),
        (("c9", 1, 1, 1.0, 0, -0.5, 0), "avg_days_between_orders >= 0"),
        (("c9", 1, 1, 1.0, 0, None, 0), "avg_days_between_orders is present"),
        (("c9", 1, 1, 1.0, 0, 0.0, -1), "churn_label between 0 and 1"),
    ],
)
def test_raw_contract(spark, row, rule):
    df = rfm_rows(spark, [*GOOD, row])
    assert broken(df, Q.raw_rules(df)) == {rule: 1}


def test_raw_contract_is_strict_about_types(spark):
    df = rfm_rows(spark, GOOD)
    df = df.withColumn("frequency", df.frequency.cast("string"))
    with pytest.raises(Q.QualityError, match="frequency is string instead of bigint"):
        Q.validate_raw(df)
    with pytest.raises(Q.QualityError, match="monetary is absent"):
        Q.validate_raw(rfm_rows(spark, GOOD).drop("monetary"))


def test_engineered_contract(spark):
    df = store_rows(spark)
    Q.validate_schema(df)
    # Five columns must not be negative; the others may be.
    Q.validate_schema(df.withColumn("avg_days_between_orders", -df.avg_days_between_orders))
    for column in ("recency_days", "frequency", "monetary", "avg_order_value", "days_per_order"):
        with pytest.raises(Q.QualityError, match=f"{column} >= 0: 2 rows"):
            Q.validate_schema(df.withColumn(column, -df[column]))


def test_sample_is_stable(spark):
    rows = rfm_rows(spark, [(f"c{i}", 1, 1, 1.0, 0, 0.0, 0) for i in range(200)])
    picks = [
        {r[0] for r in Q.validation_sample(rows.repartition(n), 20).collect()} for n in (1, 7)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 20
    assert Q.validation_sample(rows, 500).count() == 200
    assert {r[0] for r in Q.validation_sample(rows, 20, seed=7).collect()} != picks[0]


def test_score_rules(spark):
    columns = "churn_probability double, churn_prediction int, found boolean"
    good = spark.createDataFrame([(0.5, 1, True), (None, None, False)], columns)
    assert broken(good, Q.score_rules(good)) == {}
    bad = spark.createDataFrame([(1.5, 2, True), (None, None, True), (0.5, 1, False)], columns)
    assert sum(broken(bad, Q.score_rules(bad)).values()) == 6


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert sorted(map(tuple, Q.duplicate_keys(df, "k").collect()), key=str) == [(1, 2), (None, 1)]
    report = Q.pk_violations({"orders": df, "unkeyed": df}, {"orders": "k"}).collect()
    assert list(map(tuple, report)) == [("orders", 1, 1)]
    with pytest.raises(Q.QualityError):
        Q.enforce_primary_key(df, "k", "orders")
    Q.enforce_primary_key(df.where("k = 2"), "k", "orders")


def test_null_counts_include_nan(spark):
    df = rfm_rows(spark, [*RFM_ROWS, ("c4", 1, 1, math.nan, 0, math.nan, 0)])
    counts = {r["column_name"]: r["n_nulls"] for r in Q.null_counts(df).collect()}
    assert counts["monetary"] == 1 and counts["avg_days_between_orders"] == 2
    assert counts["frequency"] == 0


def test_key_uniqueness(spark):
    df = rfm_rows(spark, [*GOOD, GOOD[0]])
    assert tuple(Q.key_uniqueness(df).first()) == (3, 2, 1)
