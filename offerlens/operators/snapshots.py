"""Runs over time: diffs, retention, cache validity, upserts and the gates before a result replaces an older one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .small import attach

# Fixed values.
PRICE_STEP = 0.05
MAX_BLOCKED = 0.20
MIN_RATED_RATIO = 0.66
MIN_PREVIOUS = 20
KEEP_RUNS = 26
OFFER_DAYS, HIT_DAYS, MISS_DAYS, BLOCKED_DAYS, UNDATED_BLOCK_DAYS, MARKET_DAYS = 7, 90, 30, 7, 1, 30
PAGE_RATIO = 0.90
SOFT_MISSES = ("no_entry", "fuzzy", "winery_level")


class Implausible(Exception):
    """A new result must not replace the old one."""


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """One row per key of either side with ``change``: new, gone, price, rated, status or none.

    Both sides have ``price, rating, status``. A price counts as changed from
    ``PRICE_STEP`` on; the order of the labels decides where several hold.
    """
    a = old.select(key, F.col("price").alias("old_price"), F.col("rating").alias("old_rating"), F.col("status").alias("old_status"), F.lit(True).alias("_old"))
    b = new.select(key, F.col("price").alias("new_price"), F.col("rating").alias("new_rating"), F.col("status").alias("new_status"), F.lit(True).alias("_new"))
    both = a.join(b, key, "full_outer")
    delta = F.round(F.col("new_price") - F.col("old_price"), 2)
    change = (F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "gone").when(F.abs(delta) >= PRICE_STEP, "price")
              .when(F.col("old_rating").isNull() & F.col("new_rating").isNotNull(), "rated")
              .when(~F.col("old_status").eqNullSafe(F.col("new_status")), "status").otherwise("none"))
    return both.withColumn("delta", delta).withColumn("change", change).drop("_old", "_new")


def new_flags(current: DataFrame, previous: DataFrame, key: str, ratio: float = MIN_RATED_RATIO) -> DataFrame:
    """Flag keys the previous run lacked, unless that run was too small beside this one to tell."""
    seen = previous.select(F.col(key)).distinct().withColumn("_seen", F.lit(True))
    sizes = current.agg(F.count(F.lit(1)).alias("_now")).crossJoin(previous.agg(F.count(F.lit(1)).alias("_before")))  # one row
    fair = F.col("_before") >= ratio * F.col("_now")
    return current.join(seen, key, "left").crossJoin(F.broadcast(sizes)).withColumn("is_new", F.when(fair, F.col("_seen").isNull()).otherwise(False)).drop("_seen", "_now", "_before")


def plausibility(current: DataFrame, previous_rated: int | None) -> DataFrame:
    """One row of figures and a verdict; ``check`` raises on it."""
    m = current.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("rating").isNotNull()).alias("rated"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    before = F.lit(previous_rated).cast("long")
    verdict = (F.when(F.col("total") == 0, "empty").when(F.col("blocked") > MAX_BLOCKED * F.col("total"), "blocked")
               .when((before >= MIN_PREVIOUS) & (F.col("rated") < MIN_RATED_RATIO * before), "fewer rated").otherwise("ok"))
    return m.withColumn("verdict", verdict)


def check(current: DataFrame, previous_rated: int | None) -> None:
    row = plausibility(current, previous_rated).first()
    if row["verdict"] != "ok":
        raise Implausible(f"{row['verdict']}: {row['rated']} of {row['total']} rated, {row['blocked']} blocked")


def page_verdict(new_rows: Column, old_rows: Column, new_run: Column, old_run: Column) -> Column:
    """``ok``, or why a page must stay: it shows a later run, or the new one has under ``PAGE_RATIO`` of its rows."""
    return (F.when(old_rows.isNull(), "ok").when(old_run.isNotNull() & (new_run < old_run), "later run").when(new_rows < PAGE_RATIO * old_rows, "fewer rows").otherwise("ok"))


def fresh_verdict(rated_at: Column, youngest_offer: Column) -> Column:
    """``stale`` where ratings are older than the newest offer."""
    return F.when(rated_at.isNull() | (youngest_offer.isNotNull() & (rated_at < youngest_offer)), "stale").otherwise("ok")


def check_page(new_rows: int, old_rows: int | None, new_run: str, old_run: str | None, force: bool = False) -> None:
    """Refuse to replace a page by one of an older run or with under ``PAGE_RATIO`` of its rows."""
    if force or old_rows is None:
        return
    if old_run is not None and new_run < old_run:
        raise Implausible("the page shows a later run")
    if new_rows < PAGE_RATIO * old_rows:
        raise Implausible(f"{new_rows} rows would replace {old_rows}")


def check_fresh(rated_at: object, youngest_offer: object) -> None:
    """Refuse ratings that are older than the newest offer."""
    if rated_at is None or (youngest_offer is not None and rated_at < youngest_offer):
        raise Implausible("ratings are older than the offers")


def days_between(earlier: Column, later: Column) -> Column:
    seconds = lambda c: c.cast("timestamp").cast("double")
    return (seconds(later) - seconds(earlier)) / 86400.0


def rating_valid(status: Column, fetched: Column, retry_after: Column, now: Column) -> Column:
    """Whether a cached rating still holds: hits long, soft misses shorter, blocks until their date but never for long."""
    age = days_between(fetched, now)
    blocked = F.when(retry_after.isNotNull(), (now < retry_after) & (age <= BLOCKED_DAYS)).otherwise(age <= UNDATED_BLOCK_DAYS)
    return F.when(status == "blocked", blocked).when(status == "error", False).when(status.isin(*SOFT_MISSES), age <= MISS_DAYS).otherwise(age <= HIT_DAYS)


def market_price_valid(fetched: Column, now: Column) -> Column:
    return days_between(fetched, now) <= MARKET_DAYS


def live_offers(offers: DataFrame, now: Column, fetched: str = "fetched_at", days: int = OFFER_DAYS) -> DataFrame:
    return offers.where(F.col(fetched) >= now - F.expr(f"INTERVAL {days} DAYS"))


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Last write wins on a key. ``max_by`` aggregates before the shuffle where a window would not."""
    rest = [c for c in rows.columns if c not in keys]
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(at, tie)).alias("_t"))
    return top.select(*keys, *(F.col("_t")[c].alias(c) for c in rest)).select(*rows.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` with the rows of ``incoming`` in place of those with the same key."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def import_missing(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` and those of ``incoming`` whose key it lacks; nothing is overwritten."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def uncovered_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of an old export that a new one would lose."""
    return old.select(*keys).distinct().join(new.select(*keys), keys, "left_anti")


def replace_source(existing: DataFrame, fetched: DataFrame, reports: DataFrame) -> DataFrame:
    """Swap the offers of every source that answered with some; sources that failed or were empty keep theirs."""
    good = reports.where((F.col("status") == "ok") & (F.col("offers") > 0)).select("source").distinct()
    kept = attach(existing, good, ["source"], "left_anti")
    return kept.unionByName(attach(fetched, good, ["source"], "left_semi"), allowMissingColumns=True)


def daily_runs(runs: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    """The last run of every local day, newest ``keep`` days. One row a run: a single task sees dates only."""
    day = F.to_date("started_at")
    last = runs.groupBy(day.alias("day")).agg(F.max("id").alias("id"))
    newest = last.orderBy(F.desc("id")).limit(keep)
    return runs.join(F.broadcast(newest.select("id")), "id", "left_semi")


def previous_run(runs: DataFrame, today: Column) -> DataFrame:
    """The latest run that is not of today."""
    return runs.where(F.to_date("started_at") < today).orderBy(F.desc("id")).limit(1)


def drop_without_field(ratings: DataFrame, path: str, payload: str = "payload") -> DataFrame:
    """Ratings but those hits whose payload lacks a field; misses stay."""
    lacking = F.get_json_object(payload, path).isNull() & F.col("status").isin("exact", "wine_level", "fuzzy", "winery_level")
    return ratings.where(~lacking)


def drop_confidence(ratings: DataFrame, confidence: str, payload: str = "payload") -> DataFrame:
    return ratings.where(~F.coalesce(F.get_json_object(payload, "$.match_confidence") == confidence, F.lit(False)))


def cache_stats(ratings: DataFrame, offers: DataFrame) -> DataFrame:
    """One row: ratings, offers and the youngest offer."""
    a = ratings.agg(F.count(F.lit(1)).alias("ratings"))
    return a.crossJoin(offers.agg(F.count(F.lit(1)).alias("offers"), F.max("fetched_at").alias("youngest_offer")))


def run_date(started: Column, zone: str) -> Column:
    """Local day of a UTC instant: runs are one a local day."""
    return F.to_date(F.from_utc_timestamp(started, zone))


def sellers_of(offers: DataFrame, source: str, payload: str = "payload") -> DataFrame:
    """Sellers that appear under one adapter's key."""
    return offers.where(F.col("source_key") == source).select(F.get_json_object(payload, "$.retailer").alias("seller")).distinct()


def check_schema_version(version: int, known: int) -> None:
    if version > known:
        raise ValueError(f"the cache has schema {version}; this library knows {known}")


def migrate(cache: DataFrame, version: int, known: int, renamed: dict[int, dict[str, str]]) -> DataFrame:
    """A cache brought to the schema this library knows: the columns that each later version ``renamed``; a newer cache is refused."""
    check_schema_version(version, known)
    for v in range(version + 1, known + 1):
        cache = cache.withColumnsRenamed(renamed.get(v, {}))
    return cache


def order_changes(diff: DataFrame) -> DataFrame:
    return diff.orderBy("change", F.col("delta").asc_nulls_last(), *([F.col("key")] if "key" in diff.columns else []))


def windowed_seen(runs: DataFrame, key: str, run: str) -> DataFrame:
    """First and last run that each key appears in, and in how many."""
    return runs.groupBy(key).agg(F.min(run).alias("first_run"), F.max(run).alias("last_run"), F.count_distinct(run).alias("runs"))


def rank_runs(runs: DataFrame) -> DataFrame:
    return runs.withColumn("age", F.row_number().over(Window.orderBy(F.desc("started_at"))) - 1)
