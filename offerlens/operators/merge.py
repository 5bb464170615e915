"""Offers of one item across sellers: deduplication, merging, best prices, spreads, pivots.

There is no row order in a DataFrame. Where a rule says "the first one wins",
ties go to the smaller seller and then the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

CONFIDENCE = ("low", "medium", "high")


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def better_first(price: str = "price", confidence: str = "confidence") -> list[Column]:
    """Order in which the better of two prices of one seller comes first; a missing or zero price is the dearest."""
    return [F.desc(confidence_rank(F.col(confidence))), F.coalesce(F.nullif(F.col(price), F.lit(0.0)), F.lit(9e9)).asc()]


def dedupe_offers(offers: DataFrame, name: str = "name", order: str = "position") -> DataFrame:
    """One offer per name and vintage within a source.

    Going through a source in its order, a low-confidence incumbent yields to a
    challenger that is not low, else the cheaper one stays even if it is low. That
    depends on the whole order, so rows are dealt by product and sorted there, and
    each product is folded as a stream that holds one offer. Offers at one place go
    by price, confidence, then their other columns.
    """
    keys = ["_source", "_name", "_vintage"]
    first = [order, "price", "confidence"]
    ties = [c for c, t in offers.dtypes if c not in first and "map<" not in t and t != "variant"]
    keyed = offers.withColumns({"_source": F.col("source"), "_name": F.lower(F.trim(F.col(name))), "_vintage": F.col("vintage")})
    dealt = keyed.repartition(*keys).sortWithinPartitions(*keys, *first, *ties)
    schema, columns = offers.schema, offers.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None  # the product that is read, and its kept offer: a batch of one row
        for b in batches:
            names = b.schema.names
            column = lambda c, b=b, names=names: b.column(names.index(c)).to_pylist()
            low = [c == "low" for c in column("confidence")]
            cost = [p or 9e9 for p in column("price")]
            done, kept = [], None  # places of offers that stay; the incumbent's place, None while it is the held one
            for i, key in enumerate(zip(*(column(k) for k in keys), strict=True)):
                if key != at:
                    if kept is not None:
                        done.append(kept)
                    elif held is not None:
                        yield held
                    at, held, kept = key, None, i
                    state = (low[i], cost[i])
                elif (state[0] and not low[i]) or cost[i] < state[1]:
                    held, kept, state = None, i, (low[i], cost[i])
            rows = b.select(columns)
            if done:
                yield rows.take(pa.array(done))
            if kept is not None:
                held = rows.take(pa.array([kept]))
        if held is not None:
            yield held

    return dealt.mapInArrow(run, schema)


def merge_offers(offers: DataFrame, key: str = "dedup_key") -> DataFrame:
    """One row per item: shown name (the longest normalised one), flags, and one price per seller."""
    per = Window.partitionBy(key, "seller").orderBy(*better_first(), "name", "url")
    best = offers.withColumn("_r", F.row_number().over(per)).where("_r = 1").drop("_r")
    # the shown name and flags look at all offers, prices at the best per seller
    wide = offers.groupBy(key).agg(
        F.min_by("name", F.struct(-F.length("normalized_name"), F.col("seller"), F.col("name"))).alias("name"),
        F.min_by("vintage", F.struct(F.col("vintage").isNull(), -F.length("normalized_name"), F.col("seller"), F.col("name"), F.col("vintage"))).alias("vintage"), F.max("private_label").alias("private_label"))
    priced = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seller", "price", "confidence", "url"))).alias("prices"))
    return wide.join(priced, key)


def best_price(prices: Column) -> Column:
    """Least price that is not low-confidence, of ``array<struct<seller, price, confidence>>``."""
    return F.array_min(F.transform(F.filter(prices, lambda p: p["confidence"] != "low"), lambda p: p["price"]))


def cheapest_seller(prices: Column) -> Column:
    best = best_price(prices)
    return F.coalesce(F.get(F.filter(prices, lambda p: p["price"] == best), F.lit(0))["seller"], F.lit(""))


def seller_count(prices: Column) -> Column:
    return F.size(F.array_distinct(F.transform(prices, lambda p: p["seller"])))


def spread(prices: Column) -> Column:
    """Greatest minus least price over at least two that are not low-confidence."""
    sure = F.transform(F.filter(prices, lambda p: (p["confidence"] != "low") & p["price"].isNotNull()), lambda p: p["price"])
    return F.when(F.size(sure) >= 2, F.round(F.array_max(sure) - F.array_min(sure), 2))


def item_prices(offers: DataFrame, item: str, seller: str) -> DataFrame:
    """The relational form of the same: best price, its seller, sellers, spread and offers per item.

    Both steps are aggregates, so offers are reduced per seller before they are shuffled and nothing is sorted.
    """
    rank = F.struct(-confidence_rank(F.col("confidence")), F.coalesce(F.nullif(F.col("price"), F.lit(0.0)), F.lit(9e9)))
    best = offers.groupBy(item, seller).agg(F.min_by(F.struct("price", "confidence"), rank).alias("_b"), F.count(F.lit(1)).alias("_n"))
    sure = F.when(F.col("_b.confidence") != "low", F.col("_b.price"))
    return best.groupBy(item).agg(
        F.min(sure).alias("best_price"), F.min_by(F.when(sure.isNotNull(), F.col(seller)), F.struct(sure.isNull(), sure, F.col(seller))).alias("cheapest_seller"),
        F.count(F.lit(1)).alias("sellers"), F.when(F.count(sure) >= 2, F.round(F.max(sure) - F.min(sure), 2)).alias("spread"), F.sum("_n").alias("offers"))


def critic_max(critics: DataFrame, item: str = "item") -> DataFrame:
    """Per item and critic the highest score with its seller, and a note where sellers disagree."""
    return critics.groupBy(item, "critic").agg(
        F.max("score").alias("score"), F.min_by("seller", F.struct(-F.col("score"), F.col("seller"))).alias("seller"),
        F.when(F.count_distinct(F.round("score")) > 1, F.concat_ws(" / ", F.transform(F.array_sort(F.collect_set(F.round("score"))), lambda s: s.cast("int").cast("string")))).alias("conflict"))


def pivot_prices(prices: DataFrame, item: str, seller: str, price: str, sellers: list) -> DataFrame:
    """One column per named seller; the list is given, so no pass over the data finds it."""
    return prices.groupBy(item).pivot(seller, sellers).agg(F.min(price))


def seller_list(sellers: DataFrame, seller: str, most: int = 5000) -> list:
    """The sellers of a dimension in order, as columns for ``pivot_prices``; a table of more is no dimension."""
    got = [r[0] for r in sellers.select(seller).distinct().orderBy(seller).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} sellers make no columns")
    return got


def band_summary(rows: DataFrame, bands: list[str]) -> DataFrame:
    """Rows and rated rows of every band, empty bands too."""
    spark = rows.sparkSession
    all_bands = spark.createDataFrame([(b, i) for i, b in enumerate(bands)], "band string, position int")
    counts = rows.groupBy("band").agg(F.count(F.lit(1)).alias("total"), F.count("rating").alias("rated"))
    return all_bands.join(F.broadcast(counts), "band", "left").select("band", "position", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("rated", F.lit(0)).alias("rated"))


def status_distribution(rows: DataFrame, status: str) -> DataFrame:
    counts = rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))
