"""Value scores: grouped residuals that fall back from fine to coarse, and positions within price bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .small import attach

# Fixed values.
MIN_SAMPLE = 12
PRICE_WEIGHT = 0.70
COUNT_ANCHOR = 50
RARITY_SHARE = 0.5


def effective_rating(rows: DataFrame, rating: str = "rating", price: str = "price", out: str = "effective") -> DataFrame:
    """Blend each rating with how rare it is among all rated rows with a price.

    The count of rows at least as good is a running sum over the few distinct
    tenths, not a window over all rows, and comes back as a small table: one row per
    rating step of the scale.
    """
    ok = F.col(rating).isNotNull() & (F.col(price) > 0)
    step = F.round(F.col(rating), 1)
    levels = rows.where(ok).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("c"))
    better = F.sum("c").over(Window.orderBy(F.desc("step")))
    levels = levels.withColumn("better", better).withColumn("n", F.sum("c").over(Window.partitionBy()))
    levels = levels.withColumn("rarity", -F.log10(F.col("better") / F.col("n")))
    whole = Window.partitionBy()
    mean = lambda x: F.sum(F.col("c") * F.col(x)).over(whole) / F.col("n")
    levels = levels.withColumn("mr", mean("step")).withColumn("mx", mean("rarity"))
    spread = lambda x, m: F.sqrt(F.sum(F.col("c") * (F.col(x) - F.col(m)) * (F.col(x) - F.col(m))).over(whole) / F.col("n"))
    levels = levels.withColumn("sr", spread("step", "mr")).withColumn("sx", spread("rarity", "mx"))
    usable = (F.col("n") >= MIN_SAMPLE) & (F.col("sr") > 0) & (F.col("sx") > 0)
    scaled = F.col("mr") + (F.col("rarity") - F.col("mx")) * F.col("sr") / F.col("sx")
    levels = levels.select("step", F.when(usable, scaled).alias("scaled"))
    joined = attach(rows.withColumn("step", F.when(ok, step)), levels, ["step"])
    blend = F.when(F.col("scaled").isNotNull(), (1 - RARITY_SHARE) * F.col(rating) + RARITY_SHARE * F.col("scaled")).otherwise(F.col(rating))
    return joined.withColumn(out, blend).drop("step", "scaled")


def _sums(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Count, sums and price range of cells, from finer cells or from rows as cells of one."""
    return rows.groupBy(*keys).agg(
        F.sum("_n").alias(f"_{name}_n"), F.sum("_sx").alias(f"_{name}_sx"), F.sum("_sy").alias(f"_{name}_sy"), F.min("_lo").alias(f"_{name}_lo"), F.max("_hi").alias(f"_{name}_hi"))


def value_scores(rows: DataFrame, world: str | None, kind: str = "kind", style: str = "style", region: str = "region") -> DataFrame:
    """Score of every row with a rating and a price: how far it lies above the price level of its group.

    Rows have ``effective, price, rating_count``; scores are taken within
    ``world`` (or over everything). A kind that is unknown or thin joins the rest;
    a style, then a region in it, overrides where it has a sample of its own and
    its prices differ. Rows are aggregated once, to the finest cells, which a task
    folds before anything is shuffled; all coarser levels are sums of those, and
    each row then looks up its cell's reference.
    """
    pool_of = ["_world"]
    base = rows.where(F.col("rating").isNotNull() & (F.col("price") > 0)).withColumns({
        "_world": F.col(world) if world else F.lit(1), "_x": F.log10("price"),
        "_kind": F.when(F.coalesce(F.col(kind), F.lit("")).isin("", "unbekannt"), "").otherwise(F.col(kind)),
        "_style": F.coalesce(F.col(style), F.lit("")), "_region": F.coalesce(F.col(region), F.lit(""))})
    finest = [*pool_of, "_kind", "_style", "_region"]
    fine = base.groupBy(*finest).agg(F.count(F.lit(1)).alias("_n"), F.sum("_x").alias("_sx"), F.sum("effective").alias("_sy"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    thin = F.sum("_n").over(Window.partitionBy(*pool_of, "_kind")) < MIN_SAMPLE  # over cells, not rows
    fine = fine.withColumn("_pool", F.when(thin, "").otherwise(F.col("_kind")))
    cells = fine.select(*finest, "_pool")
    levels = [("pool", [*pool_of, "_pool"]), ("style", [*pool_of, "_pool", "_style"]), ("region", [*pool_of, "_pool", "_style", "_region"])]
    for name, keys in levels:
        cells = cells.join(_sums(fine, keys, name).withColumnsRenamed({k: "_k" + k for k in keys}), [F.col(k).eqNullSafe(F.col("_k" + k)) for k in keys]).drop(*("_k" + k for k in keys))

    def ok(name: str) -> Column:
        good = (F.col(f"_{name}_n") >= MIN_SAMPLE) & (F.col(f"_{name}_hi") > F.col(f"_{name}_lo"))
        return good & (F.col("_style_n") >= MIN_SAMPLE) & (F.col("_region") != "") if name == "region" else good

    def pick(of: str) -> Column:
        at = lambda name: F.col(f"_{name}_{of}") / (1 if of == "n" else F.col(f"_{name}_n"))
        return F.when(ok("region"), at("region")).when(ok("style"), at("style")).when(ok("pool"), at("pool"))

    cells = cells.select(
        *finest, F.when(ok("region"), "region").when(ok("style"), "style").when(ok("pool"), "pool").alias("ref_level"),
        pick("n").cast("long").alias("ref_n"), pick("sx").alias("_rx"), pick("sy").alias("_ry"))
    count = F.coalesce(F.col("rating_count"), F.lit(0))
    expected = F.col("_ry") + PRICE_WEIGHT * (F.col("_x") - F.col("_rx"))
    out = attach(base, cells, finest).withColumns({
        "value_score": (F.col("effective") - expected) * (count / (count + F.lit(COUNT_ANCHOR))),
        "ref_price": F.round(F.pow(F.lit(10.0), F.col("_rx")), 2), "ref_rating": F.round(F.col("_ry"), 2)})
    return out.drop("_x", "_rx", "_ry", *finest)


def trade_world(swiss: Column, marketplace: Column) -> Column:
    """``handel``: sold at home or nowhere else; ``marktplatz``: only there."""
    return F.when(swiss | ~marketplace, "handel").otherwise("marktplatz")


def band_score(rows: DataFrame, rating: str = "rating", price: str = "price", band: str = "band") -> DataFrame:
    """``value_score`` 0..100 of each row within its band: the rating's position counts twice, the price's once."""
    ok = rows.where(F.col(rating).isNotNull() & (F.col(price) > 0))
    ends = ok.groupBy(band).agg(F.min(rating).alias("_rl"), F.max(rating).alias("_rh"), F.min(price).alias("_pl"), F.max(price).alias("_ph"))

    def at(c: str, lo: str, hi: str) -> Column:
        return F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.5)

    score = F.round(100 * (2 * at(rating, "_rl", "_rh") + (1 - at(price, "_pl", "_ph"))) / 3, 1)
    return attach(ok, ends, [band]).withColumn("value_score", score).drop("_rl", "_rh", "_pl", "_ph")


def ols(rows: DataFrame, y: str, x: Column, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``y`` on ``x``."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col(y), x).alias("slope"), F.regr_intercept(F.col(y), x).alias("intercept"))
