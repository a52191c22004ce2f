"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b); component is the smallest id reached.

    Each round takes the least label around an id and then the label of that label,
    so long chains shrink by halves. Rounds are written to the shared folder.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.filter("a <> b").distinct(), "links")
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near"))
    labels = materialize(labels.select("id", F.least("id", "near").alias("component")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id"))
        around = around.agg(F.min("component").alias("least"))
        lower = labels.join(around, "id", "left").select("id", "component", F.least("component", "least").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("further"))
        new = lower.join(jump, "next", "left").select(
            "id", F.coalesce(F.least("next", "further"), "next").alias("component"), (F.col("component") > F.least("next", F.coalesce("further", "next"))).alias("moved")
        )
        new = materialize(new, "labels")
        if not new.filter("moved").head(1):
            return new.select("id", "component")
        labels = new.select("id", "component")
