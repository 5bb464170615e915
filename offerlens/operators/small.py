"""Joins with tables that are usually small, decided by their counted size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

#: Rows up to which a table is broadcast.
MOST = 50_000


def dealt(table: DataFrame) -> DataFrame:
    """A side of a join that grows with its data: both sides are shuffled, as its bytes on disk do not tell how many rows it has."""
    return table.hint("merge")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by ``key`` to as many tasks as a shuffle has: for work that a few small files would leave to a task or two."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def attach(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left", most: int = MOST) -> DataFrame:
    """``rows`` joined with ``table`` on equal or equally null ``on``.

    The table is computed once: up to ``most`` rows of it go to every task, and
    the rows stay where they are. A larger one joins by a shuffle.
    """
    got = table.limit(most + 1).collect()
    small = len(got) <= most
    other = rows.sparkSession.createDataFrame(got, table.schema) if small else table
    other = other.select(*(F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in table.columns))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on))
    return rows.join(F.broadcast(other) if small else other, same, how).drop(*(f"_on_{c}" for c in on))
