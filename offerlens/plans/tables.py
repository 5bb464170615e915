"""The star-schema tables in the roles of offers, items, ratings and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import prices as P
from ..operators import merge, scores

AS_OF = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item, seller, raw, units, tax, discount, confidence, price, shipped`` of every line item."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    price = P.cents(F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_tax")))
    conf = F.when(F.col("l_returnflag") == "N", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    return l.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("seller"), F.col("l_extendedprice").alias("raw"),
                    F.col("l_quantity").alias("units"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"),
                    conf.alias("confidence"), price.alias("price"), F.col("l_shipdate").alias("shipped"))


def best_prices(offered: DataFrame) -> DataFrame:
    return merge.item_prices(offered, "item", "seller")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated items: ``item, name, kind, style, region, rating, rating_count, marketplace, swiss, price, sellers``."""
    best = best_prices(offers(spark, sf_dir))
    size = F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("name"),
        F.when(size % 5 == 0, "").when(size % 5 == 1, "unbekannt").when(size % 5 == 2, "straff").when(size % 5 == 3, "weich").otherwise("suess").alias("kind"),
        F.col("p_type").alias("style"), F.col("p_brand").alias("region"),
        F.when(size % 7 != 0, F.round(3.0 + size / 25.0, 2)).alias("rating"), (F.col("p_partkey") % 3 == 0).alias("marketplace"), (F.col("p_partkey") % 2 == 0).alias("swiss"))
    return p.join(best.select("item", F.col("best_price").alias("price"), "sellers", "cheapest_seller", F.col("offers").alias("rating_count")), "item")


def scored(spark: SparkSession, sf_dir: str, per_world: bool = True) -> DataFrame:
    rows = scores.effective_rating(items(spark, sf_dir))
    rows = rows.withColumn("world", scores.trade_world(F.col("swiss"), F.col("marketplace")))
    return scores.value_scores(rows, "world" if per_world else None)


OFFERS_SQL = """
offers AS (
  SELECT l_partkey AS item, l_suppkey AS seller, l_extendedprice AS raw, l_quantity AS units, l_tax AS tax, l_discount AS discount,
    CASE l_returnflag WHEN 'N' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence,
    round(l_extendedprice / l_quantity * (1 + l_tax) + 1e-9, 2) AS price, l_shipdate AS shipped
  FROM lineitem)"""
BEST_SQL = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item, seller ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, coalesce(nullif(price, 0), 9e9)) AS r
  FROM offers),
best AS (
  SELECT item, min(CASE WHEN confidence <> 'low' THEN price END) AS best_price,
    arg_min(seller, price * 1000000 + seller) FILTER (WHERE confidence <> 'low') AS cheapest_seller, count(*) AS sellers,
    CASE WHEN count(CASE WHEN confidence <> 'low' THEN price END) >= 2
      THEN round(max(CASE WHEN confidence <> 'low' THEN price END) - min(CASE WHEN confidence <> 'low' THEN price END), 2) END AS spread
  FROM ranked WHERE r = 1 GROUP BY item)"""
ITEMS_SQL = """
counts AS (SELECT item, count(*) AS rating_count FROM offers GROUP BY item),
items AS (
  SELECT p_partkey AS item, p_name AS name,
    CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'unbekannt' WHEN 2 THEN 'straff' WHEN 3 THEN 'weich' ELSE 'suess' END AS kind,
    p_type AS style, p_brand AS region, CASE WHEN p_size % 7 <> 0 THEN round(3.0::DOUBLE + p_size / 25.0::DOUBLE, 2) END AS rating,
    p_partkey % 3 = 0 AS marketplace, p_partkey % 2 = 0 AS swiss, best_price AS price, sellers, cheapest_seller, rating_count
  FROM part JOIN best ON best.item = p_partkey JOIN counts ON counts.item = p_partkey)"""
ALL_SQL = f"WITH {OFFERS_SQL.strip()},{BEST_SQL},{ITEMS_SQL}"
EFFECTIVE_SQL = """
sample AS (SELECT * FROM items WHERE rating IS NOT NULL AND price > 0),
levels AS (SELECT round(rating, 1) AS step, count(*) AS c FROM sample GROUP BY 1),
rare AS (SELECT step, c, sum(c) OVER (ORDER BY step DESC) AS better, sum(c) OVER () AS n FROM levels),
rare2 AS (SELECT *, -log10(better / n) AS rarity FROM rare),
stat AS (SELECT sum(c * step) / sum(c) AS mr, sum(c * rarity) / sum(c) AS mx, sum(c) AS n FROM rare2),
stat2 AS (SELECT mr, mx, stat.n, sqrt((SELECT sum(c * (step - mr) * (step - mr)) FROM rare2, stat) / stat.n) AS sr,
  sqrt((SELECT sum(c * (rarity - mx) * (rarity - mx)) FROM rare2, stat) / stat.n) AS sx FROM stat),
effective AS (
  SELECT s.*, CASE WHEN t.n >= 12 AND t.sr > 0 AND t.sx > 0 THEN 0.5 * s.rating + 0.5 * (t.mr + (r.rarity - t.mx) * t.sr / t.sx) ELSE s.rating END AS effective
  FROM sample s JOIN rare2 r ON r.step = round(s.rating, 1) CROSS JOIN stat2 t)"""


def score_sql(pool: str) -> str:
    """The hierarchical score with ``pool`` (a world column, or a constant)."""
    def cell(name: str, keys: str) -> str:
        return (f"count(*) OVER (PARTITION BY {keys}) AS {name}_n, avg(x) OVER (PARTITION BY {keys}) AS {name}_x, avg(effective) OVER (PARTITION BY {keys}) AS {name}_y, "
                f"max(x) OVER (PARTITION BY {keys}) > min(x) OVER (PARTITION BY {keys}) AS {name}_d")

    return f"""
worlds AS (SELECT *, CASE WHEN swiss OR NOT marketplace THEN 'handel' ELSE 'marktplatz' END AS world, log10(price) AS x,
  CASE WHEN kind IN ('', 'unbekannt') THEN '' ELSE kind END AS k FROM effective),
pools AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY {pool}, k) < 12 THEN '' ELSE k END AS p FROM worlds),
cells AS (SELECT *, {cell('po', f'{pool}, p')}, {cell('st', f'{pool}, p, style')}, {cell('re', f'{pool}, p, style, region')} FROM pools),
picked AS (SELECT *, CASE WHEN re_n >= 12 AND re_d AND st_n >= 12 AND region <> '' THEN 'region' WHEN st_n >= 12 AND st_d THEN 'style' WHEN po_n >= 12 AND po_d THEN 'pool' END AS ref_level FROM cells),
refs AS (SELECT *, CASE ref_level WHEN 'region' THEN re_n WHEN 'style' THEN st_n WHEN 'pool' THEN po_n END AS ref_n,
  CASE ref_level WHEN 'region' THEN re_x WHEN 'style' THEN st_x WHEN 'pool' THEN po_x END AS rx,
  CASE ref_level WHEN 'region' THEN re_y WHEN 'style' THEN st_y WHEN 'pool' THEN po_y END AS ry FROM picked),
scored AS (SELECT *, (effective - (ry + 0.7::DOUBLE * (x - rx))) * (rating_count / (rating_count + 50.0::DOUBLE)) AS value_score FROM refs)"""
