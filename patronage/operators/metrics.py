"""Classification metrics as one-row DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.columns import count_where
from patronage.operators.ordering import running_totals
from patronage.schemas import TARGET


def auc(df: DataFrame, score: str, label: str = TARGET) -> DataFrame:
    """Area under the ROC curve, exact: the share of (positive, negative) pairs
    that the score orders rightly, ties counting half. NULL with one class.

    Rows are first merged by score; a positive then needs only the number of
    negatives with a lower and with the same score.
    """
    by_score = df.groupBy(F.col(score).alias("score")).agg(
        count_where(F.col(label) == 1).alias("pos"), count_where(F.col(label) == 0).alias("neg")
    )
    ranked = running_totals(by_score, "score", ["neg"])
    half = F.lit("0.5").cast("decimal(2,1)")
    # Pair counts outgrow doubles long before decimals.
    right = F.col("pos").cast("decimal(15,0)") * (F.col("neg_before") + F.col("neg") * half)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return ranked.agg(F.try_divide(F.sum(right).cast("double"), pairs).alias("auc"))


def precision_recall(df: DataFrame, prediction: str, label: str = TARGET) -> DataFrame:
    """Precision and recall of class 1, and their counts; 0 where undefined."""
    said, real = F.col(prediction) == 1, F.col(label) == 1
    hits, wrong, missed = (
        count_where(said & real),
        count_where(said & ~real),
        count_where(~said & real),
    )

    def share(rest):
        return F.coalesce(F.try_divide(hits.cast("double"), hits + rest), F.lit(0.0))

    return df.agg(
        hits.alias("true_positives"),
        wrong.alias("false_positives"),
        missed.alias("false_negatives"),
        share(wrong).alias("precision"),
        share(missed).alias("recall"),
    )
