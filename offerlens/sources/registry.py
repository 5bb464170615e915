"""Source configuration: YAML entries merged over defaults, selection, audit rows and manual overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.prices import host
from ..operators.small import attach

SCHEMA = "key string, name string, enabled boolean, domain string, adapter string, price_basis string, vat_included boolean, urls array<string>, private_labels array<string>, kind string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """One row per retailer or rating source of a YAML file; see ``from_entries``."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_entries(spark, yaml.safe_load(f) or {})


def from_entries(spark: SparkSession, raw: dict) -> DataFrame:
    """One row per entry of ``retailers`` and ``rating_sources``; an entry's non-null values override ``defaults``."""
    defaults = raw.get("defaults") or {}
    rows = []
    for kind, section in (("retailer", "retailers"), ("rating", "rating_sources")):
        for key, entry in (raw.get(section) or {}).items():
            e = defaults | {k: v for k, v in (entry or {}).items() if v is not None}
            rows.append((key, e.get("name", key), bool(e.get("enabled", True)), e.get("domain"), e.get("adapter", key), e.get("price_basis", "auto"),
                         e.get("vat_included", True), list(e.get("urls") or e.get("promo_urls") or []), list(e.get("private_labels") or []), kind))
    return spark.createDataFrame(rows, SCHEMA)


def select(registry: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Enabled retailers, or exactly the named ones; an unknown name raises."""
    retailers = registry.where("kind = 'retailer'")
    if not keys:
        return retailers.where("enabled")
    known = {r["key"] for r in retailers.select("key").collect()}
    if unknown := sorted(set(keys) - known):
        raise KeyError(f"no such source: {', '.join(unknown)}")
    return retailers.where(F.col("key").isin(keys))


def with_overrides(rows: DataFrame, overrides: DataFrame, key: str, columns: list[str], most: int = 100_000) -> DataFrame:
    """``columns`` replaced by verified values where ``overrides`` has the key."""
    other = overrides.where(F.col(key).isNotNull()).select(key, *(F.col(c).alias("_o_" + c) for c in columns)).dropDuplicates([key])
    joined = attach(rows, other, [key], most=most)
    return joined.withColumns({c: F.coalesce("_o_" + c, c) for c in columns}).drop(*("_o_" + c for c in columns))


def fetch_report(offers: DataFrame, pages: DataFrame) -> DataFrame:
    """Audit row per source: status and number of offers. Offers beat a blocked later page."""
    n = offers.groupBy("source").agg(F.count(F.lit(1)).alias("offers"))
    p = pages.groupBy("source").agg(F.max(F.when(F.col("block").isNotNull(), F.col("block"))).alias("block"), F.count_if(F.col("status_code") >= 400).alias("failed"), F.count(F.lit(1)).alias("pages"))
    status = F.when(F.col("offers") > 0, "ok").when(F.col("block").isNotNull(), "blocked").when(F.col("failed") == F.col("pages"), "error").otherwise("empty")
    return p.join(n, "source", "left").withColumn("offers", F.coalesce("offers", F.lit(0))).withColumn("status", status)


def completeness(offers: DataFrame, claimed: DataFrame) -> DataFrame:
    """Sources that say they have more than was read."""
    n = offers.groupBy("source").agg(F.count(F.lit(1)).alias("read"))
    return claimed.join(n, "source", "left").withColumn("read", F.coalesce("read", F.lit(0))).withColumn("gap", F.col("total") - F.col("read")).where("gap > 0")


def own_hosts(prices: DataFrame, registry: DataFrame, item: str = "item") -> DataFrame:
    """Hosts that sell an item: the registered domains of its sellers and the hosts of its offers' addresses."""
    named = registry.select(F.col("key").alias("seller"), F.lower("domain").alias("domain"))
    rows = attach(prices, named, ["seller"])
    hosts = F.explode(F.filter(F.array("domain", host(F.col("url"))), lambda h: h.isNotNull()))
    return rows.select(item, hosts.alias("h")).groupBy(item).agg(F.array_sort(F.collect_set("h")).alias("hosts"))


def display_info(rows: DataFrame, registry: DataFrame, key: str = "seller") -> DataFrame:
    """Rows with their seller's name; unknown sellers keep their key."""
    names = registry.select(F.col("key").alias(key), F.col("name").alias("_name"))
    return attach(rows, names, [key]).withColumn("seller_name", F.coalesce("_name", key)).drop("_name")


# Fixed values.
SECONDS_APART, ATTEMPTS, BACK_OFF = 2.0, 3, 2.0
BUSY = (429, 503)
PROMO_WORDS = ["aktion", "angebot", "promo", "sale", "rabatt"]


def request_plan(urls: DataFrame, apart: float = SECONDS_APART) -> DataFrame:
    """When a crawler may ask for each allowed address of ``urls(url, allowed)``: one after another on a host, hosts side by side."""
    host_of = F.lower(F.try_parse_url("url", F.lit("HOST")))
    w = Window.partitionBy("host").orderBy("url")
    return urls.where("allowed").select("url", host_of.alias("host")).distinct().withColumn("start_second", apart * (F.row_number().over(w) - 1))


def retry_after(status_code: Column, attempt: Column, apart: float = SECONDS_APART) -> Column:
    """Seconds until a busy host may be asked again, twice as long each time; null if it is not to be asked."""
    return F.when(status_code.isin(*BUSY) & (attempt < ATTEMPTS), apart * F.pow(F.lit(BACK_OFF), attempt))


def resolve_urls(configured: DataFrame, landed: DataFrame, roots: DataFrame, words: list[str] = PROMO_WORDS) -> DataFrame:
    """``source, url``: the first configured address that answered, else the first link of the shop's root that names a promotion.

    ``configured(source, position, url)``, ``landed(url, status_code)``, ``roots(source, link)``.
    """
    good = configured.join(landed.where("status_code < 400").select("url").distinct(), "url").groupBy("source").agg(F.min_by("url", F.struct("position", "url")).alias("own"))
    named = roots.where(F.lower("link").rlike("|".join(words))).groupBy("source").agg(F.min("link").alias("found"))
    sources = configured.select("source").distinct()
    return sources.join(good, "source", "left").join(named, "source", "left").select("source", F.coalesce("own", "found").alias("url"))
