"""The shape of the physical plans, with every join made a shuffle join."""

import re

import pytest

from __spark_entry__ import queries
from patronage.sources.parquet_tables import open_store
from patronage.workload.queries import feature_path

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    """The initial physical plan of a query, as it would be on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda name: queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def hashed_on(text):
    return [
        re.sub(r"#\d+L?", "", m).rsplit(",", 1)[0]
        for m in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    ]


def test_flagship_moves_each_table_once(plan):
    text = plan("rfm_churn")
    assert sorted(hashed_on(text)) == [
        "customer_id",  # orders of both windows, merged per customer_id
        "customer_id",  # customers
        "customer_unique_id",  # totals per person
        "order_id",  # orders of the feature window
        "order_id",  # distinct orders of the items
        "order_id",  # sums of the payments
        "order_id, payment_value",  # payments
    ]
    assert text.count("rangepartitioning") == 1
    assert "NestedLoop" not in text and "Cartesian" not in text and "Window" not in text


def test_cutoff_and_status_reach_the_scan(plan):
    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan("rfm_churn"))
    assert any("EqualTo(o_orderstatus,F)" in p or "IsNotNull(o_orderstatus)" in p for p in pushed)
    filters = plan("rfm_churn")
    assert re.search(r"o_orderdate#\d+ < \d{4}-\d\d-\d\d 00:00:00", filters)
    assert re.search(r"o_orderdate#\d+ >= \d{4}-\d\d-\d\d 00:00:00", filters)


def test_scans_read_only_needed_columns(plan):
    schemas = re.findall(r"FileScan parquet \[([^\]]*)\]", plan("rfm_churn"))
    columns = {re.sub(r"#\d+L?", "", s) for s in schemas}
    assert columns == {
        "c_custkey",
        "l_orderkey",
        "l_orderkey,l_extendedprice",
        "o_orderkey,o_custkey,o_orderstatus,o_orderdate",
        "o_custkey,o_orderstatus,o_orderdate",
    }


def test_sweep_is_one_pass(plan):
    text = plan("churn_sweep")
    assert len(hashed_on(text)) == 6
    assert text.count("FileScan") == 4


def test_sql_form_reads_the_orders_once(plan):
    text = plan("rfm_sql_param")
    assert sorted(hashed_on(text)) == [
        "customer_id",  # orders of both windows, merged per customer_id and day
        "customer_id",  # customers
        "customer_id, day",
        "customer_unique_id, day",
        "order_id",  # orders of both windows
        "order_id",  # distinct orders of the items
        "order_id",  # sums of the payments
        "order_id, payment_value",  # payments
        "person",  # days of a person, for the window
    ]
    assert text.count("FileScan") == 4


def test_gap_query_reads_each_input_once(spark, plan):
    """Rows and openers share the shuffles they have in common when the plan runs."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df = queries()["order_gaps"](spark, FOLDER)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 4 and final.count("ReusedExchange") == 2
    assert len(re.findall(r"[-:] Exchange hashpartitioning", final)) == 10


def test_gap_window_runs_over_days(plan):
    text = plan("order_gaps")
    window = text.index("Window [lag")
    assert "SortAggregate(key=[customer_unique_id" in text[window:]


@pytest.mark.parametrize("name", ["rfm_churn", "rfm_metrics", "engineered_features", "churn_sweep", "batch_lookup"])
def test_no_python_and_no_cross_join(plan, name):
    text = plan(name)
    for word in ("Python", "Pandas", "NestedLoop", "Cartesian"):
        assert word not in text


def test_lookup_opens_the_store_without_a_job(spark, plan):
    text = plan("lookup_customer")
    assert "Exchange" not in text.replace("Exchange SinglePartition", "")
    tracker = spark.sparkContext.statusTracker()
    before = tracker.getJobIdsForGroup("open")
    spark.sparkContext.setJobGroup("open", "opening the store")
    open_store(spark, feature_path(spark, FOLDER))
    found = set(tracker.getJobIdsForGroup("open")) - set(before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) <= 1  # the schema of the files, if that


def test_lookup_filters_at_the_scan(plan):
    assert "EqualTo(customer_unique_id,4)" in plan("lookup_customer")
