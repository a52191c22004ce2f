"""A third of the orders on one customer, a third of the lines on one order.

The tables are the given ones with those keys overwritten; results must still
equal the SQL.
"""

import pytest

from __spark_entry__ import oracle_sql, queries
from compare import assert_same, connect
from patronage.operators import orders
from patronage.sources.star_tables import star_tables

SOURCE = "/root/testdata/sf0.001"
HOT_CUSTOMER = 7
AFFECTED = [
    "rfm_churn",
    "rfm_sql_param",
    "delivered_before_cutoff",
    "delivered_before_cutoff_collapse",
    "order_gaps",
    "rfm_metrics",
    "churn_labels",
    "churn_sweep",
    "key_uniqueness",
    "duplicate_item_keys",
    "batch_lookup",
    "batch_summary",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    target = tmp_path_factory.mktemp("skewed")
    con = connect(SOURCE)
    hot_order = con.execute(
        "SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < '2000-01-01'"
    ).fetchall()[0][0]
    selects = {
        "customer": "SELECT * FROM customer",
        "part": "SELECT * FROM part",
        "supplier": "SELECT * FROM supplier",
        "orders": f"""SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN {HOT_CUSTOMER}
            ELSE o_custkey END AS o_custkey) FROM orders""",
        "lineitem": f"""SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN {hot_order}
            ELSE l_orderkey END AS l_orderkey) FROM lineitem""",
    }
    for name, select in selects.items():
        con.execute(f"COPY ({select}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return str(target)


@pytest.fixture(scope="module")
def many_hot(tmp_path_factory):
    """The lines on 400 orders only, all of them hot."""
    target = tmp_path_factory.mktemp("many-hot")
    con = connect(SOURCE)
    keys = "(SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 400)"
    con.execute(f"CREATE TABLE hot AS SELECT row_number() OVER () - 1 AS i, o_orderkey AS k FROM {keys}")
    selects = {name: f"SELECT * FROM {name}" for name in ("customer", "part", "supplier", "orders")}
    selects["lineitem"] = "SELECT lineitem.* REPLACE (hot.k AS l_orderkey) FROM lineitem JOIN hot ON hot.i = l_partkey % 400"
    for name, select in selects.items():
        con.execute(f"COPY ({select}) TO '{target}/{name}.parquet' (FORMAT parquet)")
    return str(target)


@pytest.fixture
def small_tasks(spark):
    """Join by shuffle."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", AFFECTED)
def test_matches_sql(spark, folder, small_tasks, name):
    assert assert_same(queries()[name](spark, folder), connect(folder), oracle_sql()[name]) > 0


@pytest.mark.parametrize("name", ["rfm_churn", "delivered_before_cutoff", "order_gaps"])
def test_many_hot_orders(spark, many_hot, small_tasks, name):
    assert assert_same(queries()[name](spark, many_hot), connect(many_hot), oracle_sql()[name]) > 0


def test_no_order_is_one_task(spark, folder, small_tasks):
    """Payments are hashed on order and value before they are summed by order."""
    paid = star_tables(spark, folder)["order_payments"]
    plan = orders.order_spend(paid)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hash" in line]
    assert sum("payment_value" in e for e in exchanges) == 1
    assert len(exchanges) == 2
