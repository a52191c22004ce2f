"""Split, weights, metrics, training and the registry."""

import hashlib
import random
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from patronage.operators import metrics, split
from patronage.plans import registry, training
from patronage.schemas import MODEL_COLUMNS
from patronage.sources.parquet_tables import write_table
from rows import training_rows


def labelled(spark, n_positive, n_negative):
    rows = [(f"k{i}", int(i < n_positive)) for i in range(n_positive + n_negative)]
    return spark.createDataFrame(rows, "customer_unique_id string, churn_label int"), rows


@pytest.mark.parametrize(("n_positive", "n_negative"), [(300, 41), (3, 2), (1, 0), (0, 1)])
@pytest.mark.parametrize(("seed", "digits", "passes"), [(42, 4, 3), (7, 1, 1), (7, 1, 3)])
def test_split_takes_the_smallest_hashes(spark, monkeypatch, n_positive, n_negative, seed, digits, passes):
    monkeypatch.setattr(split, "DIGITS", digits)
    monkeypatch.setattr(split, "PASSES", passes)  # whatever they are, the split is the same
    df, rows = labelled(spark, n_positive, n_negative)
    expected = set()
    for label in (0, 1):
        keys = [k for k, y in rows if y == label]
        keys.sort(key=lambda k: hashlib.md5(f"{k}-{seed}".encode()).hexdigest())
        expected |= set(keys[: int(0.25 * len(keys) + 0.5)])
    sides = split.split_data(df, seed=seed).collect()
    assert len(sides) == len(rows)
    assert {r["customer_unique_id"] for r in sides if r["side"] == "test"} == expected


def test_split_ignores_partitioning(spark):
    df, _ = labelled(spark, 200, 50)
    runs = [sorted(map(str, split.split_data(df.repartition(n)).collect())) for n in (1, 6)]
    assert runs[0] == runs[1]


def test_split_ranks_no_prefix_that_grows(spark, tmp_path):
    df, _ = labelled(spark, 30_000, 10_000)
    df.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    prefix = F.substring(split.hash_order("customer_unique_id", 42), 1, split.DIGITS * split.PASSES)
    assert stored.groupBy("churn_label", prefix).count().agg(F.max("count")).first()[0] == 1
    taken = split.split_data(stored).where("side = 'test'").groupBy("churn_label").count()
    assert sorted(map(tuple, taken.collect())) == [(0, 2500), (1, 7500)]
    plan = split.split_data(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan


def test_split_without_test_rows(spark):
    df, _ = labelled(spark, 10, 10)
    assert split.split_data(df, test_size=0.0).where("side = 'test'").count() == 0
    assert split.split_data(df, test_size=1.0).where("side = 'train'").count() == 0


def test_class_weights(spark):
    df, _ = labelled(spark, 8, 2)
    assert tuple(split.class_weights(df).first()) == (2, 8, 0.25)
    weights = split.add_weight(df, 0.25).groupBy("churn_label").agg(F.max("weight")).collect()
    assert sorted(map(tuple, weights)) == [(0, 1.0), (1, 0.25)]


def test_ratio_without_positives_is_null(spark):
    df, _ = labelled(spark, 0, 3)
    assert split.class_weights(df).first()["scale_pos_weight"] is None


def brute_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    right = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return right / (len(pos) * len(neg))


@pytest.mark.parametrize("distinct", [2, 25, 100_000])
def test_auc(spark, distinct):
    rng = random.Random(distinct)
    rows = [(rng.randrange(distinct) / distinct, int(rng.random() < 0.3)) for _ in range(700)]
    df = spark.createDataFrame(rows, "score double, churn_label int")
    value = metrics.auc(df, "score").first()["auc"]
    assert value == pytest.approx(brute_auc(rows), abs=1e-12)
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="churn_label", numBins=0
    )
    assert value == pytest.approx(evaluator.evaluate(df), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, churn_label int")
    assert metrics.auc(df, "score").first()["auc"] is None


def test_precision_and_recall(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 1)] * 3 + [(0, 0)] * 5
    df = spark.createDataFrame(pairs, "guess int, churn_label int")
    assert tuple(metrics.precision_recall(df, "guess").first()) == (6, 2, 3, 0.75, 6 / 9)


def test_undefined_precision_and_recall_are_zero(spark):
    df = spark.createDataFrame([(0, 0)], "guess int, churn_label int")
    row = metrics.precision_recall(df, "guess").first()
    assert (row["precision"], row["recall"]) == (0.0, 0.0)


def test_model_settings():
    assembler, trees = training.build_model().getStages()
    assert assembler.getInputCols() == MODEL_COLUMNS
    assert len(MODEL_COLUMNS) == 9
    assert (trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize()) == (100, 4, 0.1)
    assert (trees.getSubsamplingRate(), trees.getFeatureSubsetStrategy()) == (0.8, "0.8")
    assert (trees.getSeed(), trees.getWeightCol()) == (42, "weight")


def test_training_ignores_the_layout_of_its_input(spark):
    df = training_rows(spark, 200)
    scores = []
    for n in (1, 5):
        model = training.fit(df.repartition(n), 0.7, n_estimators=3)
        scored = training.predict(model, df).orderBy("customer_unique_id")
        scores.append([r["churn_probability"] for r in scored.collect()])
    assert scores[0] == scores[1]


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("train")
    features, where = str(root / "features"), str(root / "registry")
    write_table(training_rows(spark), features)
    return features, where, training.train(spark, features, where, n_estimators=5)


def test_train(spark, trained):
    features, where, result = trained
    assert result.version == 1
    assert set(result.metrics) == {"auc", "precision", "recall"}
    assert all(0 <= v <= 1 for v in result.metrics.values())
    assert result.metrics["auc"] > 0.7
    assert result.params == {
        "model_type": "gbt",
        "n_estimators": "5",
        "max_depth": "4",
        "learning_rate": "0.1",
        "scale_pos_weight": result.params["scale_pos_weight"],
        "features_path": features,
    }
    logged = registry.latest_run(spark, where).first()
    assert logged["params"] == result.params
    assert logged["metrics"] == pytest.approx(result.metrics)


def test_versions_count_up_and_latest_is_loaded(spark, trained, tmp_path):
    _, _, result = trained
    where = str(tmp_path / "registry")
    assert registry.latest_version(spark, where) == 0
    with pytest.raises(LookupError):
        registry.load_latest(spark, where)
    assert [registry.register_model(spark, where, result.model, "r") for _ in range(2)] == [1, 2]
    model, version = registry.load_latest(spark, where)
    assert version == 2
    df = training_rows(spark, 20)
    assert training.predict(model, df).collect() == training.predict(result.model, df).collect()


def test_best_run(spark, tmp_path):
    where = str(tmp_path)
    for name, value in (("low", 0.5), ("high", 0.9), ("none", None)):
        registry.log_run(spark, where, {"name": name}, {"auc": value})
    assert registry.best_run(spark, where).first()["params"]["name"] == "high"
    assert registry.runs(spark, where).count() == 3


def test_training_needs_both_classes(spark, tmp_path):
    path = str(tmp_path / "features")
    write_table(training_rows(spark, 40).where("churn_label = 1"), path)
    with pytest.raises(ValueError, match="both classes"):
        training.train(spark, path, str(tmp_path / "registry"), n_estimators=2)


def test_trainings_at_once_get_versions_of_their_own(spark, trained, tmp_path):
    _, _, result = trained
    where = str(tmp_path / "registry")
    registry.claim_version(spark, where)  # a job that claimed version 1 and failed
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda run: registry.register_model(spark, where, result.model, run, 8), "abcd"))
    assert sorted(versions) == [2, 3, 4, 5]
    rows = registry.versions(spark, where).collect()
    assert {(r["version"], r["n_partitions"]) for r in rows} == {(v, 8) for v in versions}
    assert len({r["path"] for r in rows}) == 4
    assert registry.load_latest(spark, where)[1] == 5


def test_training_reads_rows_that_are_laid_out_once(spark, monkeypatch):
    """The trees are given stored rows, in the layout that their sampling follows; these go with the training."""
    df, seen = training_rows(spark, 100), {}

    class Spy:
        def fit(self, rows):
            seen["plan"] = rows._jdf.queryExecution().executedPlan().toString()
            seen["rows"] = rows.rdd.glom().collect()
            seen["files"] = {Path(f) for f in Path(folder).rglob("rdd-*") if f not in before}
            return "model"

    training.checkpoint_training(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(Path(folder).rglob("rdd-*"))
    monkeypatch.setattr(training, "build_model", lambda *_: Spy())
    assert training.fit(df, 0.7) == "model"
    assert "Exchange" not in seen["plan"] and "Sort" not in seen["plan"]
    laid_out = training.fixed_layout(split.add_weight(df, 0.7), training.PARTITIONS)
    assert seen["rows"] == laid_out.select(*MODEL_COLUMNS, "churn_label", "weight").rdd.glom().collect()
    assert seen["files"] and not any(f.exists() for f in seen["files"])


def test_stored_rows_give_the_trees_of_the_plan(spark):
    df = training_rows(spark, 300)
    lazy = training.build_model(4).fit(training.fixed_layout(split.add_weight(df, 0.7), training.PARTITIONS))
    probabilities = [
        [r["churn_probability"] for r in training.predict(model, df).orderBy("customer_unique_id").collect()]
        for model in (lazy, training.fit(df, 0.7, n_estimators=4))
    ]
    assert probabilities[0] == pytest.approx(probabilities[1], abs=1e-12)


def test_layout_is_a_parameter_of_the_model(spark):
    """Trees depend on the number of partitions asked for, not on the number of rows."""
    df = training_rows(spark, 100)
    assert {training.fixed_layout(rows, training.PARTITIONS).rdd.getNumPartitions() for rows in (df, df.limit(3))} == {8}
