"""Scores for one customer, for tables of requests, and for request files."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from patronage.operators import lookup
from patronage.operators.quality import QualityError, enforce, score_rules
from patronage.plans import scoring, training
from patronage.schemas import FEATURE_COLUMNS
from patronage.sources.parquet_tables import open_store, write_store, write_table
from patronage.streaming.scoring_stream import answers, request_stream, score_stream, stored_scores
from patronage.workload import queries
from rows import STORE_ROWS, store_rows, training_rows


@pytest.fixture(scope="module")
def model(spark):
    return training.fit(training_rows(spark, 120), 0.8, n_estimators=3)


@pytest.fixture(scope="module")
def store(spark):
    return store_rows(spark)


def ask(spark, *ids):
    return lookup.request_table(spark, ids)


def score(spark, model, store, *ids):
    return scoring.score_batch(model, store, ask(spark, *ids))


def test_store_status(store):
    assert tuple(scoring.store_status(store, 3).first()) == ("ok", "3", 2)


def test_known_customer(model, store):
    row = scoring.score_customer(model, store, "cust_001", 1).first()
    assert row["customer_id"] == "cust_001" and row["model_version"] == "1"
    assert 0.0 <= row["churn_probability"] <= 1.0
    assert row["churn_prediction"] == int(row["churn_probability"] > 0.5)


def test_unknown_customer(model, store):
    with pytest.raises(LookupError, match="does_not_exist"):
        scoring.score_customer(model, store, "does_not_exist", 1)


@pytest.mark.parametrize(
    ("ids", "found"),
    [
        (("cust_001", "cust_002"), [True, True]),
        (("cust_001", "unknown_id"), [True, False]),
        (("ghost_1", "ghost_2"), [False, False]),
        (("cust_002", "ghost", "cust_002", "cust_001"), [True, False, True, True]),
    ],
)
def test_batch(spark, model, store, ids, found):
    scored = score(spark, model, store, *ids)
    rows = scored.collect()
    assert [r["customer_id"] for r in rows] == list(ids)
    assert [r["found"] for r in rows] == found
    for r in rows:
        assert (r["churn_probability"] is None) == (not r["found"])
        assert (r["churn_prediction"] is None) == (not r["found"])
    enforce(scored, score_rules(scored), "scores")
    summary = scoring.score_summary(scored, 1).first()
    assert tuple(summary) == (len(ids), sum(found), len(ids) - sum(found), "1")


def test_batch_and_single_scores_agree(spark, model, store):
    one = scoring.score_customer(model, store, "cust_002", 1).first()
    many = score(spark, model, store, "cust_002").first()
    assert one["churn_probability"] == many["churn_probability"]


def test_only_requested_customers_are_scored(spark, model, store):
    asked = lookup.requested(store, ask(spark, "cust_002", "cust_002", "ghost"))
    assert [r["customer_unique_id"] for r in asked.collect()] == ["cust_002"]


def test_single_event(model, store):
    events = scoring.score_events(scoring.score_customer(model, store, "cust_001", 1))
    event = json.loads(events.first()["event_json"])
    assert event["event"] == "predict" and event["customer_id"] == "cust_001"
    assert set(event) == {
        "event", "customer_id", "churn_probability", "churn_prediction", "model_version",
    }


def test_batch_event(spark, model, store):
    summary = scoring.score_summary(score(spark, model, store, "cust_001", "ghost"), 1)
    event = json.loads(scoring.batch_events(summary).first()["event_json"])
    assert event == {
        "event": "batch_predict", "n_requested": 2, "n_found": 1, "n_not_found": 1,
        "model_version": "1",
    }


def test_events_keep_null_fields(store):
    row = store.limit(1).select(
        F.lit("ghost").alias("customer_id"),
        F.lit(None).cast("double").alias("churn_probability"),
        F.lit(None).cast("int").alias("churn_prediction"),
        F.lit("1").alias("model_version"),
    )
    event = json.loads(scoring.score_events(row).first()["event_json"])
    assert event["churn_probability"] is None and event["churn_prediction"] is None


def test_open_store(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        open_store(spark, str(tmp_path / "absent"))
    write_table(store_rows(spark, [*STORE_ROWS, STORE_ROWS[0]]), str(tmp_path / "twice"))
    with pytest.raises(QualityError, match="cust_001"):
        open_store(spark, str(tmp_path / "twice"))
    write_table(store_rows(spark).drop("monetary"), str(tmp_path / "short"))
    with pytest.raises(ValueError, match="monetary"):
        open_store(spark, str(tmp_path / "short"))


def test_lookup(store):
    assert lookup.lookup_customer(store, "cust_002").first()["frequency"] == 5
    assert lookup.lookup_customer(store, "ghost").isEmpty()


class Requests:
    """Request files that land one by one, and the stream that answers them."""

    def __init__(self, spark, model, store, folder):
        self.spark, self.model, self.store = spark, model, store
        self.inbox, self.outbox, self.state = (str(folder / n) for n in ("in", "out", "state"))
        self.schema = ask(spark, "x").schema
        self.scores = stored_scores(model, store, str(folder / "scores"), n_buckets=3)

    def arrive(self, start, *ids):
        rows = [(start + i, c) for i, c in enumerate(ids)]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.inbox)

    def run(self):
        stream = request_stream(self.spark, self.inbox, self.schema, files_per_trigger=1)
        score_stream(self.scores, stream, self.outbox, self.state).awaitTermination()
        return self.answered()

    def answered(self):
        return sorted(map(str, self.spark.read.parquet(self.outbox).collect()))

    def batch(self):
        requests = self.spark.read.schema(self.schema).parquet(self.inbox)
        return sorted(map(str, scoring.score_batch(self.model, self.store, requests).collect()))


@pytest.fixture
def requests(spark, model, store, tmp_path):
    return Requests(spark, model, store, tmp_path)


def test_stream_equals_batch_and_resumes(requests):
    requests.arrive(0, "cust_001", "ghost", "cust_001")
    requests.arrive(3, "cust_002")
    assert requests.run() == requests.batch()
    requests.arrive(4, "cust_002", "ghost")
    assert len(requests.run()) == 6
    assert requests.answered() == requests.batch()
    assert requests.run() == requests.batch()  # nothing new


def drop(path):
    """Remove a file of a log and its checksum."""
    path.unlink()
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("sink_knew", [True, False])
def test_restart_in_mid_batch(requests, tmp_path, sink_knew):
    """A job that ends before its last batch is committed, with the batch's files written."""
    requests.arrive(0, "cust_001", "ghost")
    before = requests.run()
    requests.arrive(2, "cust_002", "cust_002", "ghost")
    requests.run()
    drop(tmp_path / "state" / "commits" / "1")
    if not sink_knew:
        drop(tmp_path / "out" / "_spark_metadata" / "1")
        assert requests.answered() == before  # readers see whole batches only
    requests.arrive(5, "ghost")
    assert requests.run() == requests.batch()
    assert len(requests.answered()) == 6


def test_requests_meet_a_bucketed_store_where_it_lies(spark, model, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = write_store(store_rows(spark), str(tmp_path / "store"), n_buckets=3)
        asked = spark.createDataFrame([(0, "cust_001"), (1, "ghost"), (2, "cust_001")], "pos int, customer_id string")
        scored = scoring.score_batch(model, store, asked)
        text = scored._jdf.queryExecution().executedPlan().toString()
        store_side = text[text.index("LeftSemi") : text.index("FileScan parquet")]
        assert "Exchange" not in store_side and "Bucketed: true" in text
        assert [r["found"] for r in scored.collect()] == [True, False, True]
        scores = stored_scores(model, store, str(tmp_path / "scores"), n_buckets=3)
        plan = answers(scores, asked)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_opens_one_bucket(spark, tmp_path):
    store = write_store(store_rows(spark), str(tmp_path / "store"), n_buckets=3)
    assert lookup.lookup_customer(store, "cust_002").first()["frequency"] == 5
    # Where nothing else uses the buckets, the plan names them only if told not to leave them out.
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    found = lookup.lookup_customer(store, "cust_002")
    assert "SelectedBucketsCount: 1 out of 3" in found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    reopened = open_store(spark, str(tmp_path / "store"))
    assert reopened.count() == 2 and reopened.columns == store.select(*FEATURE_COLUMNS).columns
    write_store(store_rows(spark, STORE_ROWS[:1]), str(tmp_path / "store"), n_buckets=2)
    assert open_store(spark, str(tmp_path / "store")).count() == 1


def star_folder(spark, folder, first):
    """A star schema of 40 customers from key ``first`` on with three orders each, half of them active after the cutoff."""
    orders, day = [], datetime.datetime(2020, 1, 1)
    for c in range(first, first + 40):
        for k in range(3):
            late = k == 2 and c % 2 == 0
            orders.append((3 * c + k, c, "F", day + datetime.timedelta(days=700 if late else 7 * k + c % 30)))
    spark.createDataFrame([(c,) for c in range(first, first + 40)], "c_custkey bigint").write.parquet(f"{folder}/customer.parquet")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz"
    spark.createDataFrame(orders, schema).write.parquet(f"{folder}/orders.parquet")
    lines = [(o, 1, 1, 1, 1.0, 10.0 + o % 7, "N") for o, *_ in orders]
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, schema).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize(("first", "scored"), [(0, 1), (1000, 0)])
def test_queries_of_one_customer_where_keys_may_be_others(spark, tmp_path, monkeypatch, first, scored):
    monkeypatch.setattr(queries, "ROUNDS", 2)
    folder = star_folder(spark, tmp_path / "star", first)
    row = queries.score_customer(spark, folder)
    assert row.count() == scored and row.columns == ["customer_id", *scoring.SCORES, "model_version"]
    judged = queries.score_customer_judged(spark, folder).collect()
    assert [(r["customer_id"], r["error"]) for r in judged] == [("4", None)] * scored + [("-1", "absent")]


def test_the_streaming_query_reads_its_scores_a_fixed_number_of_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ROUNDS", 1)
    paths = {}
    monkeypatch.setattr(queries, "new_path", lambda _, name: paths.setdefault(name, str(tmp_path / name)))
    folder = star_folder(spark, tmp_path / "star", 0)
    orders = spark.read.parquet(f"{folder}/orders.parquet").collect()
    schema = spark.read.parquet(f"{folder}/orders.parquet").schema
    spark.createDataFrame(orders, schema).repartition(10).write.mode("overwrite").parquet(f"{folder}/orders.parquet")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "2000")
    try:
        answered = queries.score_stream_available(spark, folder).select("pos", "customer_id", "found").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(spark.read.parquet(paths["inbox"]).inputFiles()) > 6
    commits = [p for p in (tmp_path / "stream-state" / "commits").iterdir() if p.name.isdigit()]
    assert len(commits) == queries.STREAM_BATCHES
    assert sorted(answered) == sorted((o["o_orderkey"], o["o_custkey"], True) for o in orders)
