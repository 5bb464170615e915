"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge: ``(id, component)``.

    ``edges`` has long columns ``u, v``; direction, repeats and self loops do
    not matter, and an empty table gives an empty result. Each round sends every
    node's label to its neighbours, keeps the smallest (a partial aggregate, so
    a node of any degree is folded before the shuffle) and then replaces labels
    by their own labels, which halves the remaining path lengths.
    """
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = scratch.save(e)
    both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(
        e.select(F.col("v").alias("a"), F.col("u").alias("b")))
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    for _ in range(max_rounds):
        sent = both.join(labels, both.b == labels.id).select(F.col("a").alias("id"), "component")
        near = sent.unionByName(labels).groupBy("id").agg(F.min("component").alias("next"))
        # the label of a label: the smallest id known to the node this node points at
        jump = near.select(F.col("id").alias("next"), F.col("next").alias("far"))
        new = near.join(jump, "next", "left").select("id", F.least("next", F.coalesce("far", "next")).alias("component"))
        new = scratch.save(new)
        before = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s"))
        after = new.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s"))
        moved = before.first()["s"] != after.first()["s"]
        scratch.drop(labels)
        labels = new
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
