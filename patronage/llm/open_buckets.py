"""Buckets of candidates that hold several components, cut into groups of bounded size.

Texts that share a bucket and are linked already need no comparison. In the other buckets the nodes
outside the largest component meet all nodes, in cells, so that no task holds a whole bucket and
no row is made for a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Nodes of a bucket that meet in one group, on each side.
CELL = 1024


def open_rows(rows: DataFrame, labels: DataFrame, sized: bool = False) -> DataFrame:
    """Rows (key, node, and what else they hold) of buckets that hold several components, with their component.

    ``largest`` is the bucket's largest component. With u of its s nodes outside of that,
    ``n_x`` = u / CELL and ``n_y`` = s / CELL, rounded up. ``sized`` adds s as ``bucket``."""
    labelled = rows.join(labels.withColumnRenamed("id", "node"), "node", "left")
    labelled = labelled.select(*rows.columns, F.coalesce("component", "node").alias("component"))
    parts = labelled.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("size")).filter("size > most.n")
    cells = [F.ceil(n / CELL).cast("long").alias(name) for n, name in ((F.col("size") - F.col("most.n"), "n_x"), (F.col("size"), "n_y"))]
    size = [F.col("size").alias("bucket")] if sized else []
    return labelled.join(buckets.select("key", F.col("most.component").alias("largest"), *cells, *size), "key")


def groups_of(rows: DataFrame) -> DataFrame:
    """Groups (key, x, y) in which nodes of different components of a bucket meet.

    The nodes outside the largest component lie in cells x, all nodes in cells y. A group
    takes the nodes of its x (``outside``) and of its y, so every node outside meets every other."""
    cell = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    across = F.transform(F.sequence(F.lit(0), F.col("n_y") - 1), lambda y: F.struct(cell("n_x").alias("x"), y.alias("y"), F.lit(True).alias("outside")))
    down = F.transform(F.sequence(F.lit(0), F.col("n_x") - 1), lambda x: F.struct(x.alias("x"), cell("n_y").alias("y"), F.lit(False).alias("outside")))
    group = F.when(F.col("component") != F.col("largest"), F.concat(across, down)).otherwise(down)
    return rows.select("key", "node", "component", F.explode(group).alias("at")).select("key", "at.*", "node", "component")


def together(groups: DataFrame) -> DataFrame:
    """The rows of a group in one task, one after the other."""
    return groups.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Of rows that ``together`` has sorted: rows, and where the groups among them that are complete start and end."""
    kept: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([kept, rows]).combine_chunks() if kept is not None else rows
        ids = np.stack([rows.column(c).to_numpy() for c in ("key", "x", "y")])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()]
        yield rows, list(zip(cuts, cuts[1:], strict=False))
        kept = rows.slice(cuts[-1])  # the last group may go on in the next batch
    if kept is not None and kept.num_rows:
        yield kept, [(0, kept.num_rows)]
