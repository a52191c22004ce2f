"""Class-weighted boosted trees: build, fit, evaluate, record."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.operators.metrics import auc, precision_recall
from patronage.operators.split import SEED, TEST, TRAIN, add_weight, class_ratio, split_data
from patronage.plans.registry import log_run, register_model
from patronage.schemas import CUSTOMER_KEY, MODEL_COLUMNS, TARGET
from patronage.session import checkpoint_training, checkpointed, materialize
from patronage.sources.parquet_tables import read_table

# The hyperparameters the results refer to.
N_ESTIMATORS = 100
MAX_DEPTH = 4
LEARNING_RATE = 0.1
ROW_SHARE = 0.8
COLUMN_SHARE = "0.8"

MODEL_TYPE = "gbt"
# Rows per training partition when the number of partitions is derived.
#: Tasks that the training rows are laid out for, whatever their number. Row sampling follows the
#: layout, so this is a parameter of the model; a large cluster sets it to some multiple of its cores.
PARTITIONS = 8


class TrainResult(NamedTuple):
    model: PipelineModel
    version: int
    run_id: str
    params: dict[str, str]
    metrics: dict[str, float]


def build_model(n_estimators: int = N_ESTIMATORS, seed: int = SEED) -> Pipeline:
    """Assemble the model columns, then boosted trees on weighted rows.

    The class weight is a column of the training rows, see ``add_weight``.
    """
    trees = GBTClassifier(
        featuresCol="features",
        labelCol=TARGET,
        weightCol="weight",
        lossType="logistic",
        maxIter=n_estimators,
        maxDepth=MAX_DEPTH,
        stepSize=LEARNING_RATE,
        subsamplingRate=ROW_SHARE,
        featureSubsetStrategy=COLUMN_SHARE,
        seed=seed,
    )
    return Pipeline(stages=[VectorAssembler(inputCols=MODEL_COLUMNS, outputCol="features"), trees])


def fixed_layout(df: DataFrame, n_partitions: int, key: str = CUSTOMER_KEY) -> DataFrame:
    """Rows laid out by key. Row sampling follows the layout of the input, so
    the same rows, seed and ``n_partitions`` give the same trees."""
    return df.repartition(n_partitions, key).sortWithinPartitions(key)


def fit(
    train_rows: DataFrame,
    ratio: float,
    n_estimators: int = N_ESTIMATORS,
    seed: int = SEED,
    n_partitions: int = PARTITIONS,
) -> PipelineModel:
    checkpoint_training(train_rows.sparkSession)
    rows = fixed_layout(add_weight(train_rows, ratio), n_partitions)
    with checkpointed(rows.select(*MODEL_COLUMNS, TARGET, "weight")) as stored:
        return build_model(n_estimators, seed).fit(stored)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``churn_probability`` of class 1 and the hard ``churn_prediction``."""
    return (
        model.transform(df)
        .withColumn("churn_probability", vector_to_array("probability")[1])
        .withColumn("churn_prediction", F.col("prediction").cast("int"))
        .drop("features", "rawPrediction", "probability", "prediction")
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """One row (auc, precision, recall) of scored rows, which are read twice."""
    scored = scored.select(TARGET, "churn_probability", "churn_prediction")
    quality = precision_recall(scored, "churn_prediction").select("precision", "recall")
    return auc(scored, "churn_probability").crossJoin(quality)


def train(
    spark: SparkSession,
    features_path: str,
    registry: str,
    n_estimators: int = N_ESTIMATORS,
    seed: int = SEED,
    n_partitions: int = PARTITIONS,
) -> TrainResult:
    """Split, weigh, fit, evaluate; store the model version and the run."""
    features = read_table(spark, features_path)
    sides = materialize(split_data(features, seed=seed), "split")
    train_rows = sides.where(F.col("side") == TRAIN)
    ratio = train_rows.agg(class_ratio()).first()[0]
    if ratio is None or ratio == 0:
        raise ValueError("training needs rows of both classes")
    model = fit(train_rows, ratio, n_estimators, seed, n_partitions)
    scored = materialize(predict(model, sides.where(F.col("side") == TEST)), "scored")
    metrics = evaluate(scored).first().asDict()
    params = {
        "model_type": MODEL_TYPE,
        "n_estimators": str(n_estimators),
        "max_depth": str(MAX_DEPTH),
        "learning_rate": str(LEARNING_RATE),
        "scale_pos_weight": str(round(ratio, 3)),
        "features_path": features_path,
    }
    run_id = log_run(spark, registry, params, metrics)
    version = register_model(spark, registry, model, run_id, n_partitions)
    return TrainResult(model, version, run_id, params, metrics)
