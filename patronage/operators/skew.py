"""Joins of a many-rows side with a side that is unique by key.

One key may hold a large share of the rows. Nothing is looked for or listed: the
many-rows side reaches the join through a shuffle that the planner puts there, and
adaptive execution splits any partition of it that turns out too large, sending the
few rows of the other side to each piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_on_unique(
    many: DataFrame, one: DataFrame, key: str, how: str = "inner", distinct: bool = False
) -> DataFrame:
    """Join ``many`` to ``one``, where ``one`` has at most one row per key.

    ``how`` is inner or left; for both, the side of ``many`` may be split.

    ``distinct`` de-duplicates ``many`` first, hashed on all its columns, so that
    rows of one key are spread over tasks by their other values.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"join_on_unique supports inner and left, not {how!r}")
    if distinct:
        many = many.distinct()
    return many.join(one, key, how)
