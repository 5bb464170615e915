"""Joins on keys that one value may hold a third of."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is hot if it holds more rows than this, and more than one in ``SHARE``; there are at most ``SHARE`` such keys.
HOT_ROWS, SHARE = 1000, 2000


def hot_limit(rows: int) -> int:
    """Rows from which on a key counts as hot in a table of so many."""
    return max(HOT_ROWS, rows // SHARE)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None, rows: int | None = None, small: int = 0) -> DataFrame:
    """``left`` joined (inner or left) with ``right``, whose ``on`` columns are unique.

    Rows of hot keys meet their partner by broadcast, at most ``SHARE`` rows of
    ``right``, so no task gathers them; all others by an ordinary join. ``counts``
    may give ``on`` and ``_n``, the rows of ``left`` by key, if they are known. All of
    ``right`` is broadcast if it has at most ``small`` rows, which are then counted.
    """
    if small and right.count() <= small:
        return left.join(F.broadcast(right), on, how)
    n = left.count() if rows is None else rows
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    hot = counts.where(F.col("_n") > hot_limit(n)).select(*on).dropna()
    keys = [tuple(r) for r in hot.collect()]  # at most SHARE
    if not keys:
        return left.join(right, on, how)
    few = left.sparkSession.createDataFrame(keys, hot.schema)
    partner = F.broadcast(right.join(F.broadcast(few), on, "left_semi"))
    crowd = left.join(F.broadcast(few), on, "left_semi").join(partner, on, how)
    return crowd.unionByName(left.join(F.broadcast(few), on, "left_anti").join(right, on, how))
