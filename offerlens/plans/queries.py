"""Registered queries: every relational operator on the star-schema tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import prices as P
from ..operators import explore, merge, resolve, scores, snapshots
from . import tables as T
from .tables import ALL_SQL, BEST_SQL, EFFECTIVE_SQL, OFFERS_SQL, offers, score_sql, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {OFFERS_SQL.strip()} SELECT item, seller, shipped, raw, units, price,
  CASE WHEN confidence <> 'low' AND price IS NOT NULL THEN 1 ELSE 0 END AS usable FROM offers""")
def normalize_unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir)
    return o.select("item", "seller", "shipped", "raw", "units", "price", P.usable(F.col("price"), F.col("confidence")).cast("int").alias("usable"))


_BAND = "CASE WHEN price IS NULL THEN '' WHEN price >= 0 AND price < 10 THEN '<10' WHEN price >= 10 AND price < 20 THEN '10-20' WHEN price >= 20 AND price < 40 THEN '20-40' WHEN price >= 40 AND price < 80 THEN '40-80' ELSE '>80' END"


@query(ALL_SQL + f""", banded AS (SELECT {_BAND} AS band, rating FROM (SELECT price / 20 AS price, rating FROM items))
SELECT b.band, b.position, count(i.band) AS total, count(i.rating) AS rated
FROM (VALUES ('<10', 0), ('10-20', 1), ('20-40', 2), ('40-80', 3), ('>80', 4)) b(band, position) LEFT JOIN banded i ON i.band = b.band GROUP BY 1, 2""")
def price_band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.items(spark, sf_dir).withColumn("band", P.price_band(F.col("price") / 20))
    return merge.band_summary(rows, [b for b, _, _ in P.BANDS])


@query(f"""WITH {OFFERS_SQL.strip()}, d AS (SELECT item, seller, round(price * (1 - discount * 6), 2) AS paid, price, seller % 3 = 0 AS own FROM offers),
e AS (SELECT *, CASE WHEN paid > 0 AND price > 0 AND paid < price THEN round((1 - paid / price) * 100, 1) END AS percent FROM d)
SELECT CASE WHEN percent IS NULL THEN 'unknown' WHEN own AND percent > 45 THEN 'questionable' ELSE 'ok' END AS plausibility, count(*) AS n, max(percent) AS most FROM e GROUP BY 1""")
def discount_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir).withColumn("paid", F.round(F.col("price") * (1 - F.col("discount") * 6), 2))
    o = o.withColumn("percent", P.discount_percent(F.col("paid"), F.col("price")))
    verdict = P.rate_discount(F.col("percent"), F.col("seller") % 3 == 0)
    return o.groupBy(verdict.alias("plausibility")).agg(F.count(F.lit(1)).alias("n"), F.max("percent").alias("most"))


@query("""WITH o AS (SELECT l_orderkey AS a, l_linenumber AS b, round(l_extendedprice / l_quantity + 1e-9, 2) AS price, l_extendedprice AS raw, CAST(l_quantity AS INT) AS units,
  CASE WHEN l_linenumber % 4 <> 0 THEN 750 END AS ml, l_linenumber % 3 = 0 AS vat_added, l_linenumber % 2 = 0 AS is_pack FROM lineitem),
g AS (SELECT *, CASE WHEN vat_added THEN raw * (1 + 0.081) ELSE raw END AS gross, price * (coalesce(ml, 750) / 750.0::DOUBLE) AS bottle FROM o),
h AS (SELECT *, bottle * units AS pack FROM g)
SELECT a, b, CASE WHEN abs(gross - pack) <= greatest(0.05, pack * 0.01) THEN round(gross + 1e-9, 2)
  WHEN units > 1 AND abs(gross - bottle) <= greatest(0.05, bottle * 0.01) THEN round(gross * units + 1e-9, 2)
  WHEN ml IS NOT NULL THEN round(pack + 1e-9, 2)
  ELSE round(CASE WHEN is_pack THEN gross ELSE gross * units END + 1e-9, 2) END AS total FROM h""")
def payable_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    total = P.payable_total(P.cents(F.col("l_extendedprice") / F.col("l_quantity")), F.col("l_extendedprice"), F.col("l_quantity").cast("int"),
                            F.when(F.col("l_linenumber") % 4 != 0, 750), F.col("l_linenumber") % 3 == 0, F.col("l_linenumber") % 2 == 0)
    return l.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), total.alias("total"))


@query(f"WITH {OFFERS_SQL.strip()},{BEST_SQL} SELECT item, best_price, cheapest_seller, sellers FROM best")
def best_offer_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.best_prices(offers(spark, sf_dir)).select("item", "best_price", "cheapest_seller", "sellers")


@query(f"WITH {OFFERS_SQL.strip()},{BEST_SQL} SELECT item, sellers, spread FROM best WHERE sellers > 1 AND spread IS NOT NULL")
def cross_retailer_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.best_prices(offers(spark, sf_dir)).where("sellers > 1 AND spread IS NOT NULL").select("item", "sellers", "spread")


@query(f"""WITH {OFFERS_SQL.strip()}, named AS (
  SELECT p_brand || ' ' || p_type AS dedup_key, p_name AS name, seller, price, confidence, seller % 10 = 0 AS own,
    row_number() OVER (PARTITION BY p_brand || ' ' || p_type, seller ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, coalesce(nullif(price, 0), 9e9), p_name, p_partkey) AS r
  FROM offers JOIN part ON p_partkey = item)
SELECT dedup_key, arg_min(name, lpad(CAST(1000 - length(name) AS VARCHAR), 5, '0') || lpad(CAST(seller AS VARCHAR), 9, '0') || name) AS shown, max(CASE WHEN own THEN 1 ELSE 0 END) AS own,
  count(*) FILTER (WHERE r = 1) AS sellers, min(price) FILTER (WHERE r = 1 AND confidence <> 'low') AS best_price FROM named GROUP BY 1""")
def merge_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.concat_ws(" ", "p_brand", "p_type").alias("dedup_key"), F.col("p_name").alias("name"))
    o = offers(spark, sf_dir).join(p, "item").select(
        "dedup_key", "name", F.col("name").alias("normalized_name"), "seller", "price", "confidence", F.lpad(F.col("item").cast("string"), 12, "0").alias("url"),
        F.lit(None).cast("int").alias("vintage"), (F.col("seller") % 10 == 0).cast("int").alias("private_label"))
    m = merge.merge_offers(o)
    return m.select("dedup_key", F.col("name").alias("shown"), F.col("private_label").alias("own"), merge.seller_count(F.col("prices")).alias("sellers"), merge.best_price(F.col("prices")).alias("best_price"))


@query("""WITH c AS (SELECT l_partkey AS item, l_shipmode AS critic, l_suppkey AS seller, 50 + CAST(l_quantity AS INT) AS score FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'parker' WHEN 1 THEN 'suckling' ELSE 'decanter' END AS l_shipmode FROM lineitem))
SELECT item, critic, max(score) AS score, arg_min(seller, (1000 - score) * 10000000::BIGINT + seller) AS seller, count(DISTINCT score) AS claims FROM c GROUP BY 1, 2""")
def critic_max_per_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    c = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.when(kind == 0, "parker").when(kind == 1, "suckling").otherwise("decanter").alias("critic"),
                                                F.col("l_suppkey").alias("seller"), (F.lit(50) + F.col("l_quantity").cast("int")).alias("score"))
    m = merge.critic_max(c)
    return m.select("item", "critic", "score", "seller", F.when(F.col("conflict").isNull(), 1).otherwise(F.size(F.split("conflict", " / "))).cast("long").alias("claims"))


@query("""SELECT p_partkey AS item,
  CASE WHEN p_size % 4 = 0 THEN round(p_size / 100.0::DOUBLE, 4) WHEN p_size % 4 = 1 THEN round((50 + p_size) / 100.0::DOUBLE, 4) WHEN p_size % 4 = 2 THEN round(p_size / 10.0::DOUBLE / 5.0, 4) END AS value,
  CASE p_size % 4 WHEN 0 THEN 'lead' WHEN 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'parker' ELSE 'vinum' END WHEN 2 THEN 'crowd' END AS source FROM part""")
def rating_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    critics = F.when(size % 4 == 1, F.map_from_arrays(F.array(F.lit("vinum"), F.when(F.col("p_partkey") % 2 == 0, "parker").otherwise("atkin")), F.array((50 + size).cast("double"), (50 + size).cast("double"))))
    got = resolve.ranking_rating(F.when(size % 4 == 0, size.cast("double")), F.lit("exact"), resolve.critic_value(critics), F.when(size % 4 >= 2, size / 10.0),
                                 resolve.rankable(F.when(size % 4 == 2, "exact").otherwise("fuzzy"), F.lit("exact")), F.lit(None).cast("double"))
    return p.select(F.col("p_partkey").alias("item"), got["value"].alias("value"), got["source"].alias("source"))


_LEGACY = ALL_SQL + f""", b AS (SELECT item, rating, price, {_BAND.replace('price', '(price / 20)')} AS band FROM items WHERE rating IS NOT NULL AND price > 0),
m AS (SELECT *, min(rating) OVER w AS rl, max(rating) OVER w AS rh, min(price) OVER w AS pl, max(price) OVER w AS ph FROM b WINDOW w AS (PARTITION BY band)),
legacy AS (SELECT item, band, price, round(100 * (2 * CASE WHEN rh > rl THEN (rating - rl) / (rh - rl) ELSE 0.5 END + (1 - CASE WHEN ph > pl THEN (price - pl) / (ph - pl) ELSE 0.5 END)) / 3, 1) AS value_score FROM m)"""


@query(_LEGACY + " SELECT item, band, value_score FROM legacy")
def legacy_band_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.items(spark, sf_dir).withColumn("band", P.price_band(F.col("price") / 20))
    return scores.band_score(rows).select("item", "band", "value_score")


@query(_LEGACY + """ SELECT band, position, item, value_score FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY value_score DESC NULLS LAST, price ASC NULLS LAST, item) AS position FROM legacy) WHERE position <= 4""")
def top_per_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores.band_score(T.items(spark, sf_dir).withColumn("band", P.price_band(F.col("price") / 20)))
    top = explore.top_per_group(rows, "band", [F.col("value_score").desc_nulls_last(), F.col("price").asc_nulls_last(), F.col("item").asc()], 4)
    return top.select("band", "position", "item", "value_score")


@query(ALL_SQL + " SELECT item, rating, price FROM items ORDER BY rating DESC NULLS LAST, item LIMIT 50")
def top_k_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.page(explore.sort_rows(T.items(spark, sf_dir), "rating", True, "item"), 0).select("item", "rating", "price")


@query(ALL_SQL + "," + EFFECTIVE_SQL + " SELECT item, rating, round(effective, 6) AS effective FROM effective")
def effective_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.items(spark, sf_dir).where("rating IS NOT NULL AND price > 0")
    return scores.effective_rating(rows).select("item", "rating", F.round("effective", 6).alias("effective"))


@query(ALL_SQL + "," + EFFECTIVE_SQL + "," + score_sql("world") + " SELECT item, world, round(value_score, 6) AS value_score FROM scored")
def hierarchical_value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scored(spark, sf_dir).select("item", "world", F.round("value_score", 6).alias("value_score"))


@query(ALL_SQL + "," + EFFECTIVE_SQL + "," + score_sql("1") + " SELECT item, round(value_score, 6) AS value_score FROM scored")
def overall_value_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scored(spark, sf_dir, per_world=False).select("item", F.round("value_score", 6).alias("value_score"))


@query(ALL_SQL + "," + EFFECTIVE_SQL + "," + score_sql("world") + " SELECT world, style, ref_level, ref_n, count(*) AS n FROM scored GROUP BY 1, 2, 3, 4")
def value_reference_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.scored(spark, sf_dir).groupBy("world", "style", "ref_level", "ref_n").agg(F.count(F.lit(1)).alias("n"))


@query(ALL_SQL + """ SELECT world, count(*) AS n, count(rating) AS rated, min(price) AS cheapest FROM (SELECT *, CASE WHEN swiss OR NOT marketplace THEN 'handel' ELSE 'marktplatz' END AS world FROM items) GROUP BY 1""")
def world_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.items(spark, sf_dir).withColumn("world", scores.trade_world(F.col("swiss"), F.col("marketplace")))
    return rows.groupBy("world").agg(F.count(F.lit(1)).alias("n"), F.count("rating").alias("rated"), F.min("price").alias("cheapest"))


@query(ALL_SQL + " SELECT item, rating, price FROM (SELECT item, rating, round(price / 60 + 1e-9, 2) AS price FROM items) WHERE rating >= 4.3 AND price <= 20")
def good_and_cheap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.good_and_cheap(T.items(spark, sf_dir).select("item", "rating", P.cents(F.col("price") / 60).alias("price")))


@query(ALL_SQL + " SELECT style, count(*) AS n, round(regr_slope(rating, log10(price)), 6) AS slope, round(regr_intercept(rating, log10(price)), 6) AS intercept FROM items WHERE rating IS NOT NULL AND price > 0 GROUP BY style")
def ols_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.items(spark, sf_dir).where("rating IS NOT NULL AND price > 0")
    return scores.ols(rows, "rating", F.log10("price"), ["style"]).select("style", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""WITH c AS (SELECT p_partkey AS item, p_name AS name, p_brand AS entity, string_split(p_name, ' ') AS tokens, p_size FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE p_size % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END DESC, item) AS r,
  min(array_to_string(list_sort(list_distinct(tokens)), ' ')) OVER (PARTITION BY entity) AS lo, max(array_to_string(list_sort(list_distinct(tokens)), ' ')) OVER (PARTITION BY entity) AS hi FROM c)
SELECT item, entity, CASE WHEN lo = hi OR r = 1 THEN 'kept' ELSE 'lost' END AS claim FROM r""")
def shared_claim_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("name"), F.col("p_brand").alias("entity"), tokens.alias("tokens"), F.array(F.lit("x")).alias("distinctive"),
        tokens.alias("found_tokens"), F.array(F.lit("x")).alias("found_distinctive"), F.when(F.col("p_size") % 3 == 0, "exact").when(F.col("p_size") % 3 == 1, "wine_level").otherwise("fuzzy").alias("confidence"), F.lit(4.0).alias("rating"))
    return resolve.shared_claims(rows).select("item", "entity", "claim")


@query(f"""WITH {OFFERS_SQL.strip()}, m AS (SELECT item, 'shop' || seller || CASE WHEN seller % 2 = 0 THEN '.ch' ELSE '.com' END AS shop, min(price) AS price FROM offers GROUP BY 1, 2),
own AS (SELECT item, shop FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY price, shop) AS r FROM m) WHERE r = 1),
rest AS (SELECT m.item, m.shop, m.price, row_number() OVER (PARTITION BY m.item ORDER BY NOT m.shop LIKE '%.ch', m.price, m.shop) AS r FROM m JOIN own ON own.item = m.item WHERE m.shop <> own.shop)
SELECT o.item, r.price AS market_price, r.shop AS market_shop, r.shop NOT LIKE '%.ch' AS "foreign" FROM own o JOIN rest r ON r.item = o.item AND r.r = 1""")
def market_price_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    shop = F.concat(F.lit("shop"), F.col("seller"), F.when(F.col("seller") % 2 == 0, ".ch").otherwise(".com"))
    m = offers(spark, sf_dir).groupBy("item", shop.alias("shop")).agg(F.min("price").alias("price"))
    rows = m.groupBy("item").agg(F.collect_list(F.struct(F.col("price").alias("per_75cl"), F.concat(F.lit("https://www."), F.col("shop"), F.lit("/x")).alias("url"))).alias("prices"),
                                 F.min_by("shop", F.struct("price", "shop")).alias("own"))
    got = P.independent_price(F.col("prices"), F.array("own"))
    return rows.select("item", got["per_75cl"].alias("market_price"), got["shop"].alias("market_shop"), got["foreign"].alias("foreign")).where("market_price IS NOT NULL")


@query(ALL_SQL + """, b AS (SELECT item, CASE WHEN price IS NOT NULL THEN round((1000.0 + rating * 20 - price) / (1000.0 + rating * 20) * 100, 1) END AS bargain, rating_count % 5 = 0 AS fr FROM items WHERE rating IS NOT NULL)
SELECT item, bargain, CASE WHEN bargain IS NULL THEN 'unknown' WHEN bargain > 65 OR fr THEN 'questionable' ELSE 'ok' END AS plausibility FROM b""")
def bargain_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.items(spark, sf_dir).where("rating IS NOT NULL")
    pct = P.bargain_percent(1000.0 + F.col("rating") * 20, F.col("price"), F.lit(True))
    return rows.select("item", pct.alias("bargain"), P.bargain_plausibility(pct, F.col("rating_count") % 5 == 0).alias("plausibility"))


def _run(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    rows = offers(spark, sf_dir).where(F.year("shipped") == year).groupBy("item").agg(F.min("price").alias("price"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("item").alias("key"), "price", F.when(F.col("n") > 2, F.col("n") * 1.0).alias("rating"), F.when(F.col("n") % 2 == 0, "exact").otherwise("fuzzy").alias("status"))


_RUNS = f"""WITH {OFFERS_SQL.strip()}, runs AS (SELECT item AS key, year(shipped) AS run, min(price) AS price, count(*) AS n FROM offers GROUP BY 1, 2),
a AS (SELECT key, price, CASE WHEN n > 2 THEN n END AS rating, n % 2 AS status FROM runs WHERE run = 1997), b AS (SELECT key, price, CASE WHEN n > 2 THEN n END AS rating, n % 2 AS status FROM runs WHERE run = 1998)"""


@query(_RUNS + """ SELECT coalesce(a.key, b.key) AS key, round(b.price - a.price, 2) AS delta, CASE WHEN a.key IS NULL THEN 'new' WHEN b.key IS NULL THEN 'gone' WHEN abs(round(b.price - a.price, 2)) >= 0.05 THEN 'price'
  WHEN a.rating IS NULL AND b.rating IS NOT NULL THEN 'rated' WHEN a.status <> b.status THEN 'status' ELSE 'none' END AS change FROM a FULL JOIN b ON a.key = b.key""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.snapshot_diff(_run(spark, sf_dir, 1997), _run(spark, sf_dir, 1998)).select("key", "delta", "change")


@query(_RUNS + " SELECT b.key, CASE WHEN (SELECT count(*) FROM a) >= 0.66 * (SELECT count(*) FROM b) THEN a.key IS NULL ELSE false END AS is_new FROM b LEFT JOIN a ON a.key = b.key")
def new_since_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.new_flags(_run(spark, sf_dir, 1998), _run(spark, sf_dir, 1997), "key").select("key", "is_new")


@query(_RUNS + """, m AS (SELECT count(*) AS total, count(rating) AS rated, 0 AS blocked FROM b)
SELECT total, rated, blocked, CASE WHEN total = 0 THEN 'empty' WHEN blocked > 0.2 * total THEN 'blocked' WHEN (SELECT count(rating) FROM a) >= 20 AND rated < 0.66 * (SELECT count(rating) FROM a) THEN 'fewer rated' ELSE 'ok' END AS verdict FROM m""")
def plausibility_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _run(spark, sf_dir, 1997).agg(F.count("rating")).first()[0]
    return snapshots.plausibility(_run(spark, sf_dir, 1998), before)



@query("""WITH n AS (SELECT max(ts) AS now FROM events), r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'exact' WHEN 'view' THEN 'no_entry' WHEN 'purchase' THEN 'blocked' WHEN 'signup' THEN 'error' ELSE 'wine_level' END AS status,
  (epoch(now) - epoch(ts)) / 86400.0 * 5 AS age, CASE WHEN event_id % 2 = 0 THEN event_id % 4 = 0 END AS due FROM events, n)
SELECT status, CASE WHEN status = 'blocked' THEN CASE WHEN due IS NOT NULL THEN due AND age <= 7 ELSE age <= 1 END WHEN status = 'error' THEN false WHEN status = 'no_entry' THEN age <= 30 ELSE age <= 90 END AS valid, count(*) AS n FROM r GROUP BY 1, 2""")
def ttl_cache_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("now"))
    kind = F.col("event_type")
    status = F.when(kind == "click", "exact").when(kind == "view", "no_entry").when(kind == "purchase", "blocked").when(kind == "signup", "error").otherwise("wine_level")
    fetched = F.timestamp_seconds(F.unix_micros(F.col("now").cast("timestamp")) / 1e6 - snapshots.days_between(F.col("ts"), F.col("now")) * 5 * 86400)
    retry = F.when(F.col("event_id") % 4 == 0, F.col("now") + F.expr("INTERVAL 1 DAY")).when(F.col("event_id") % 4 == 2, F.col("now") - F.expr("INTERVAL 1 DAY"))
    rows = e.crossJoin(F.broadcast(now)).select(status.alias("status"), snapshots.rating_valid(status, fetched, retry, F.col("now")).alias("valid"))
    return rows.groupBy("status", "valid").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], "ts", "event_id")


@query("SELECT event_id, ts FROM (SELECT event_id, ts, max(event_id) OVER (PARTITION BY CAST(ts AS DATE)) AS last FROM events) WHERE event_id = last ORDER BY event_id DESC LIMIT 26")
def runs_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"))
    return snapshots.daily_runs(runs).select(F.col("id").alias("event_id"), F.col("started_at").alias("ts"))


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def rolling_offer_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    return snapshots.live_offers(e.crossJoin(F.broadcast(now)), F.col("now"), "ts").select("event_id", "ts")


_FACET = ALL_SQL + """, f AS (SELECT coalesce(nullif(kind, ''), '?') AS kind, style, region, rating >= 4.2 AS good, price <= 700 AS cheap FROM items)
SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM f WHERE coalesce(good, false) AND coalesce(cheap, false) AND style IN ({s}) GROUP BY 2
UNION ALL SELECT 'style', style, count(*) FROM f WHERE coalesce(good, false) AND coalesce(cheap, false) AND kind IN ('weich', 'straff', '?') GROUP BY 2
UNION ALL SELECT 'region', region, count(*) FROM f WHERE coalesce(good, false) AND coalesce(cheap, false) AND style IN ({s}) AND kind IN ('weich', 'straff', '?') GROUP BY 2"""
_STYLES = ["ECONOMY", "STANDARD", "PROMO"]


@query(_FACET.replace("{s}", ", ".join(f"'{s}'" for s in _STYLES)))
def facet_counts_excluding_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = explore.Filters(choices={"kind": ["weich", "straff", "?"], "style": _STYLES}, min_rating=4.2, max_price=700)
    return explore.facet_counts(T.items(spark, sf_dir), chosen, ["kind", "style", "region"])


@query("SELECT event_type, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 1) AS share FROM events GROUP BY 1")
def status_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.status_distribution(table(spark, sf_dir, "events"), "event_type")


_GROUPS = list(range(10))


@query(f"WITH {OFFERS_SQL.strip()} SELECT item, " + ", ".join(f'min(CASE WHEN seller % {len(_GROUPS)} = {s} THEN price END) AS "{s}"' for s in _GROUPS) + " FROM offers GROUP BY item")
def pivot_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers in ten groups by their number, so that the columns are known and every offer counts."""
    o = offers(spark, sf_dir).withColumn("seller", (F.col("seller") % len(_GROUPS)).cast("int"))
    return merge.pivot_prices(o, "item", "seller", "price", _GROUPS)


@query("SELECT o.o_orderkey AS key FROM orders o WHERE year(o.o_orderdate) = 1996 AND NOT EXISTS (SELECT 1 FROM orders n WHERE year(n.o_orderdate) = 1997 AND n.o_custkey = o.o_custkey)")
def export_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("y"))
    return o.where("y = 1996").join(snapshots.uncovered_keys(o.where("y = 1996"), o.where("y = 1997"), ["cust"]), "cust", "left_semi").select("key")


@query("SELECT user_id, min(CAST(ts AS DATE)) AS first_run, max(CAST(ts AS DATE)) AS last_run, count(DISTINCT CAST(ts AS DATE)) AS runs FROM events GROUP BY 1")
def seen_across_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.windowed_seen(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "user_id", "day")
