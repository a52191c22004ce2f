"""RFM and label on hand-made cases, and against brute force on random ones."""

import random

import pytest

from patronage.operators import orders as O
from patronage.operators import rfm as R
from patronage.plans import sql
from tables import as_dict, brute_force, make_tables

D = "delivered"
# The last delivered day is 2018-08-29, so the cutoff is 2018-03-02.
CASES = [
    ("a1", "u1", D, "2018-01-01", 1, ["10.00"]),
    ("a2", "u1", D, "2018-01-31", 1, ["20.00"]),
    ("b1", "u2", D, "2018-01-01", 2, ["10.00", "10.00"]),  # equal payments collapse
    ("b2", "u2", D, "2018-02-01", 1, ["5.00"]),
    ("b3", "u2", D, "2018-08-29", 1, ["1.00"]),
    ("c1", "u3", D, "2018-01-01", 1, ["10.00", "7.00"]),
    ("c2", "u3", D, "2018-01-11", 3, ["5.00"]),
    ("d1", "u4", D, "2018-02-01", 1, ["9.00"]),
    ("d2", "u4", D, "2018-03-02", 1, ["9.00"]),  # the cutoff day is label side
    ("e1", "u5.a", D, "2018-02-20 23:59:59", 1, ["3.00"]),
    ("e2", "u5.b", D, "2018-02-20 00:00:00", 1, ["4.00"]),
    ("e3", "u5.b", D, "2018-05-01", 0, []),  # active without item or payment
    ("f1", "u6", "shipped", "2018-12-31", 1, ["1.00"]),  # does not move the dates
    ("g1", "u7", D, "2018-01-01", 0, ["1.00"]),  # no item
    ("g2", "u7", D, "2018-01-02", 1, []),  # no payment
    ("g3", "u7", D, "2018-01-03", 1, ["2.00"]),
]
EXPECTED = {
    "u1": (30, 2, 30.0, 30, 30.0, 1),
    "u2": (29, 2, 15.0, 31, 31.0, 0),
    "u3": (50, 2, 22.0, 10, 5.0, 1),
    "u5": (10, 2, 7.0, 0, 0.0, 0),
}


def by_steps(tables, churn_days=180, min_orders=2):
    """The same query from the separate operators, with the window."""
    cutoff = O.resolve_dates(tables["orders"], churn_days).cutoff_dt
    gaps = R.order_gaps(O.delivered_before_cutoff(tables, cutoff))
    active = O.active_after_cutoff(tables, cutoff)
    labelled = R.churn_labels(R.rfm_metrics(gaps, cutoff), active)
    return labelled.where(labelled["frequency"] >= min_orders)


FORMS = {
    "one_plan": R.rfm,
    "steps": by_steps,
    "sql": sql.compute_rfm,
}


@pytest.mark.parametrize("form", FORMS)
def test_hand_made_cases(spark, form):
    assert as_dict(FORMS[form](make_tables(spark, CASES))) == EXPECTED
    assert brute_force(CASES) == EXPECTED


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("seed", [1, 2])
def test_random_orders_match_brute_force(spark, form, seed):
    rng = random.Random(seed)
    orders = []
    for i in range(600):
        # One person places a third of all orders, on a few days.
        hot = rng.random() < 1 / 3
        person = "hot" if hot else f"p{rng.randrange(60)}"
        orders.append(
            (
                f"o{i}",
                f"{person}.{rng.randrange(3)}",
                rng.choice([D, D, D, "canceled"]),
                f"2018-{rng.randrange(1, 13):02d}-{rng.randrange(1, 5 if hot else 29):02d}",
                rng.choice([0, 1, 1, 3]),
                [rng.choice(["1.00", "2.50", "2.50", "99.99", None]) for _ in range(rng.randrange(5))],
            )
        )
    for churn_days in (90, 180):
        actual = as_dict(FORMS[form](make_tables(spark, orders), churn_days=churn_days))
        assert actual == brute_force(orders, churn_days)


def test_gap_rounds_away_from_zero(spark):
    # Gaps 0, 0, 0, 1 have the mean 0.25.
    orders = [
        ("a", "u1", D, "2018-01-01", 1, ["1.00", "2.00", "3.00", "4.00"]),
        ("b", "u1", D, "2018-01-02", 1, ["1.00"]),
        ("z", "u2", D, "2018-12-01", 1, ["1.00"]),
    ]
    assert as_dict(R.rfm(make_tables(spark, orders)))["u1"][4] == 0.3
    assert as_dict(by_steps(make_tables(spark, orders)))["u1"][4] == 0.3


@pytest.mark.parametrize("form", FORMS)
def test_no_delivered_order_gives_no_rows(spark, form):
    orders = [("a", "u1", "shipped", "2018-01-01", 1, ["1.00"])]
    assert as_dict(FORMS[form](make_tables(spark, orders))) == {}


def test_dates_of_no_orders_are_null(spark):
    tables = make_tables(spark, [("a", "u1", "shipped", "2018-01-01", 1, ["1.00"])])
    assert O.resolve_dates(tables["orders"]) == (None, None)


def test_result_is_ordered_by_recency(spark):
    recency = [r["recency_days"] for r in R.rfm(make_tables(spark, CASES)).collect()]
    assert recency == sorted(recency)


def test_one_order_customers_with_min_orders_one(spark):
    rows = as_dict(R.rfm(make_tables(spark, CASES), min_orders=1))
    assert rows["u4"] == (29, 1, 9.0, 0, 0.0, 0)
    assert rows["u7"] == (58, 1, 2.0, 0, 0.0, 1)


def test_unknown_person_never_counts_as_active(spark):
    orders = [
        ("a", "x", D, "2018-01-01", 1, ["1.00"]),
        ("b", "x", D, "2018-01-02", 1, ["1.00"]),
        ("c", "x", D, "2018-12-01", 1, ["1.00"]),
    ]
    tables = make_tables(spark, orders, customers=[("x", None)])
    for form in FORMS.values():
        assert as_dict(form(tables))[None][5] == 1


def test_gaps_of_rows(spark):
    tables = make_tables(spark, CASES)
    cutoff = O.resolve_dates(tables["orders"]).cutoff_dt
    rows = R.order_gaps(O.delivered_before_cutoff(tables, cutoff)).collect()
    gaps = sorted(
        (r["order_date"].isoformat(), -1 if r[4] is None else r[4])
        for r in rows
        if r["customer_unique_id"] == "u3"
    )
    assert gaps == [("2018-01-01", -1), ("2018-01-01", 0), ("2018-01-11", 10)]


def test_partitioning_changes_nothing(spark):
    tables = {k: t.repartition(5) for k, t in make_tables(spark, CASES).items()}
    assert as_dict(R.rfm(tables)) == EXPECTED


def test_churned_and_retained_split_the_customers(spark):
    tables = make_tables(spark, CASES)
    cutoff = O.resolve_dates(tables["orders"]).cutoff_dt
    metrics = R.rfm_metrics_nowindow(tables, cutoff)
    active = O.active_after_cutoff(tables, cutoff)
    gone = {r[0] for r in R.churned_customers(metrics, active).collect()}
    back = {r[0] for r in R.retained_customers(metrics, active).collect()}
    assert gone == {"u1", "u3", "u7"}
    assert back == {"u2", "u4", "u5"}


def test_sweep_equals_one_run_per_threshold(spark):
    tables = make_tables(spark, CASES)
    days = [30, 90, 180, 200]
    swept = {r["churn_days"]: (r["n_customers"], r["n_churners"]) for r in R.churn_sweep(tables, days).collect()}
    for n in days:
        expected = brute_force(CASES, n)
        assert swept[n] == (len(expected), sum(v[5] for v in expected.values()))


def test_top_recent(spark):
    rows = R.top_recent_customers(R.rfm(make_tables(spark, CASES), ordered=False), 2).collect()
    assert [r["customer_unique_id"] for r in rows] == ["u5", "u2"]


def test_missing_sql_file(tmp_path):
    with pytest.raises(FileNotFoundError):
        sql.load_query(tmp_path / "absent.sql")
