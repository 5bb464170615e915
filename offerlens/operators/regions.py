"""Names to regions by alias: an exact alias, else the longest one that a name contains."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import fold
from .small import attach


def assign(rows: DataFrame, aliases: DataFrame, name: str = "region_name", most_aliases: int = 20_000) -> DataFrame:
    """``rows`` with the ``region`` key of ``aliases`` (``alias, region``).

    The contains-join runs over the distinct names only and against the alias
    dimension, whose size is checked before it is broadcast; rows then join back
    by equality.
    """
    dim = aliases.select(fold(F.col("alias")).alias("alias"), "region").limit(most_aliases + 1)
    if dim.count() > most_aliases:
        raise ValueError("the alias table is no dimension: use a keyed join")
    names = rows.select(name).distinct().withColumn("_n", F.trim(fold(F.col(name))))
    hit = names.join(F.broadcast(dim), F.col("_n").contains(F.col("alias")) & (F.col("alias") != ""))
    rank = F.struct((F.col("_n") == F.col("alias")).alias("exact"), F.length("alias").alias("length"), F.col("alias").alias("alias"))
    best = hit.groupBy(name).agg(F.max_by("region", rank).alias("region"))
    return rows.join(best, name, "left")


def describe(rows: DataFrame, regions: DataFrame, key: str = "region") -> DataFrame:
    """``rows`` with ``region_label, price_from, price_to`` of ``regions(region, label, price_from, price_to)``: a set span, for display."""
    return attach(rows, regions.select(F.col("region").alias(key), F.col("label").alias("region_label"), "price_from", "price_to"), [key]).withColumn("region_label", F.coalesce("region_label", F.lit("")))
