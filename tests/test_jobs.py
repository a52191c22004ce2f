"""The batch jobs, from CSV files to scores."""

import json

import pyarrow.parquet as pq
import pytest

from patronage.__main__ import main, parser
from patronage.schemas import RAW_TABLES
from patronage.sources.parquet_tables import open_store, write_store, write_table
from rows import store_rows, training_rows
from test_ingest import SAMPLES
from test_rfm import CASES, EXPECTED


def csv_folder(root):
    root.mkdir()
    lines = {name: [line] for name, line in SAMPLES.items()}
    logins = sorted({c for _, c, *_ in CASES})
    lines["customers"] = [f"{c},{c.split('.')[0]},01037,x,SP" for c in logins]
    lines["orders"] = [f"{o},{c},{s},{t if ' ' in t else t + ' 08:00:00'},,,," for o, c, s, t, _, _ in CASES]
    lines["order_items"] = [f"{o},{i},p,s,,1.00,1.00" for o, _, _, _, n, _ in CASES for i in range(n)]
    lines["order_payments"] = [
        f"{o},{i},card,1,{p}" for o, *_, payments in CASES for i, p in enumerate(payments)
    ]
    for name, rows in lines.items():
        head = ",".join(RAW_TABLES[name].fieldNames())
        (root / f"{name}.csv").write_text("\n".join([head, *rows]) + "\n")
    return str(root)


def test_all_jobs(spark, tmp_path, capsys):
    at = {n: str(tmp_path / n) for n in ("tables", "rfm", "features", "registry", "requests", "out")}
    main(["load", "--raw", csv_folder(tmp_path / "raw"), "--tables", at["tables"]])
    main(["rfm", "--tables", at["tables"], "--out", at["rfm"]])
    rows = {r[0]: tuple(r[1:]) for r in spark.read.parquet(at["rfm"]).collect()}
    assert rows == EXPECTED
    main(["features", "--rfm", at["rfm"], "--out", at["features"]])
    assert open_store(spark, at["features"]).count() == len(EXPECTED)

    # Four customers are too few to train on.
    many = str(tmp_path / "many")
    write_store(training_rows(spark, 60), many)
    main(["train", "--features", many, "--registry", at["registry"], "--rounds", "2"])
    requests = spark.createDataFrame([(0, "u1"), (1, "ghost"), (2, "u1")], "pos int, customer_id string")
    write_table(requests, at["requests"])
    capsys.readouterr()
    main(["score", "--features", at["features"], "--registry", at["registry"],
          "--requests", at["requests"], "--out", at["out"]])
    event = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert event == {"event": "batch_predict", "n_requested": 3, "n_found": 2,
                     "n_not_found": 1, "model_version": "1"}
    assert spark.read.parquet(at["out"]).where("found").count() == 2
    main(["score-one", "--features", many, "--registry", at["registry"], "--customer",
          spark.read.parquet(many).first()["customer_unique_id"], "--out", str(tmp_path / "event")])
    assert json.loads(spark.read.parquet(str(tmp_path / "event")).first()["event_json"])["event"] == "predict"
    main(["score-stream", "--features", at["features"], "--registry", at["registry"], "--requests", at["requests"],
          "--out", str(tmp_path / "streamed"), "--state", str(tmp_path / "state"), "--events", str(tmp_path / "events")])
    streamed = spark.read.parquet(str(tmp_path / "streamed")).select("pos", "found", "churn_probability")
    assert sorted(streamed.collect()) == sorted(spark.read.parquet(at["out"]).select("pos", "found", "churn_probability").collect())
    assert spark.read.parquet(str(tmp_path / "events")).count() == 1
    main(["status", "--features", at["features"], "--registry", at["registry"]])
    assert "ok" in capsys.readouterr().out


def test_threshold_from_the_environment(monkeypatch):
    command = ["rfm", "--tables", "t", "--out", "o"]
    assert parser().parse_args(command).churn_days == 180
    monkeypatch.setenv("CHURN_DAYS", "90")
    assert parser().parse_args(command).churn_days == 90
    assert parser().parse_args([*command, "--churn-days", "30"]).churn_days == 30


def test_steps_are_required():
    with pytest.raises(SystemExit):
        parser().parse_args([])


def test_store_is_clustered_by_customer(spark, tmp_path):
    rows = [(f"c{i:03d}", 1, 2, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 0, i % 2) for i in range(300)]
    write_store(store_rows(spark, rows).repartition(7), str(tmp_path / "store"), n_buckets=5)
    keys = [
        pq.read_table(f)["customer_unique_id"].to_pylist()
        for f in (tmp_path / "store").glob("*.parquet")
    ]
    assert len(keys) == 5 and all(part == sorted(part) for part in keys)
    assert sorted(k for part in keys for k in part) == [r[0] for r in rows]  # no key in two files
