"""Which rating counts, and who may keep a rating that several items claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values.
STATUSES = ["exact", "wine_level", "fuzzy", "winery_level", "no_entry", "blocked", "error", "skipped"]
CONFIDENCES = ["exact", "wine_level", "winery_level", "fuzzy", "none"]
CRITIC_PRIORITY = ["parker", "suckling", "decanter", "spectator", "vinum", "gaultmillau"]
RANKING = ("exact", "wine_level")


def rankable(status: Column, confidence: Column) -> Column:
    return status.isin(*RANKING) & confidence.isin(*RANKING)


def critic_value(critics: Column, priority: list[str] = CRITIC_PRIORITY) -> Column:
    """``struct(critic, value)`` of the first critic in order of priority that scored, from a map."""
    return F.coalesce(*(F.when(critics[k].isNotNull(), F.struct(F.lit(k).alias("critic"), critics[k].alias("value"))) for k in priority))


def ranking_rating(lead: Column, lead_confidence: Column, critic: Column, crowd: Column, crowd_rankable: Column, other: Column) -> Column:
    """``struct(value, source)`` on 0..1: lead critic, then critics by priority, then the crowd, then the rest."""
    pair = lambda v, s: F.struct(F.round(v, 4).alias("value"), s.alias("source"))
    return F.coalesce(
        F.when(lead.isNotNull() & lead_confidence.isin(*RANKING), pair(lead / 100.0, F.lit("lead"))),
        F.when(critic.isNotNull(), pair(critic["value"] / 100.0, critic["critic"])),
        F.when(crowd.isNotNull() & crowd_rankable, pair(crowd / 5.0, F.lit("crowd"))),
        F.when(other.isNotNull(), pair(other / 100.0, F.lit("other"))))


def entity_id(url: Column) -> Column:
    """What a rating page's address names: the text behind the last ``/w/`` up to ``?`` or ``/``."""
    return F.nullif(F.regexp_extract(url, r".*/w/([^?/]*)", 1), F.lit(""))


def shared_claims(rows: DataFrame, entity: str = "entity") -> DataFrame:
    """Let one item keep a rating that different items claim: adds ``claim`` (kept or lost) and ``winner``.

    Rows have ``item, name, tokens, distinctive, found_tokens, found_distinctive,
    confidence, rating`` and the entity. Items whose token sets are equal are the
    same one in another year and share in peace.
    """
    rank = F.when(F.col("confidence") == "exact", 4).when(F.col("confidence") == "wine_level", 3).when(F.col("confidence") == "fuzzy", 2).when(F.col("confidence") == "winery_level", 1).otherwise(0)
    own = F.array_distinct("distinctive")
    hit = F.size(F.array_intersect(own, "found_distinctive")) - F.size(F.array_except(own, "found_distinctive"))
    foreign = F.size(F.array_except("tokens", "found_tokens"))
    signature = F.array_join(F.array_sort(F.array_distinct("tokens")), " ")
    claimed = F.col(entity).isNotNull() & F.col("rating").isNotNull()
    w = Window.partitionBy(entity)
    best = w.orderBy(F.desc(rank), F.desc(hit), foreign.asc(), "item")
    one = F.when(claimed, F.when(F.min(signature).over(w) == F.max(signature).over(w), True).otherwise(F.row_number().over(best) == 1))
    # claims are few per entity; rows without one stay out of the window
    live = rows.where(claimed).withColumn("claim", F.when(one, "kept").otherwise("lost")).withColumn("winner", F.first("name").over(best))
    rest = rows.where(~claimed).withColumn("claim", F.lit(None).cast("string")).withColumn("winner", F.lit(None).cast("string"))
    out = live.unionByName(rest)
    lost = F.col("claim") == "lost"
    return out.withColumn("rating", F.when(lost, None).otherwise(F.col("rating"))).withColumn("confidence", F.when(lost, "none").otherwise(F.col("confidence")))
