"""Rating catalogs: payloads of a search to entries, their prices and tastes, drinking windows, and critic scores in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prices as P, text as X
from ..functions.bind import let

# Fixed values.
MIN_RATINGS = 5
TASTES = ["sweetness", "tannin", "acidity", "intensity"]
STRUCTURE = "struct<sweetness:double,tannin:double,acidity:double,intensity:double,user_structure_count:bigint>"
PRICE = "struct<amount:double,currency:struct<code:string>,bottle_quantity:int,bottle_type:struct<volume_ml:int>,url:string>"
MATCH = (f"struct<vintage:struct<id:bigint,name:string,year:string,seo_name:string,wine:struct<id:bigint,name:string,type_id:int,seo_name:string,winery:struct<name:string,seo_name:string>,"
         f"region:struct<name:string,country:struct<name:string>>,style:struct<name:string,baseline_structure:{STRUCTURE}>,taste:struct<structure:{STRUCTURE}>>,"
         f"statistics:struct<ratings_average:double,ratings_count:bigint,wine_ratings_average:double,wine_ratings_count:bigint>>,price:{PRICE},prices:array<{PRICE}>>")
PAYLOAD = f"explore_vintage struct<matches:array<{MATCH}>>"
WINDOW = r'drinking_window"\s*:\s*\{\s*"start_year"\s*:\s*(null|\d{4})\s*,\s*"end_year"\s*:\s*(null|\d{4})'
POINTS = (50.0, 100.0)


class BrokenContract(ValueError):
    """A payload no longer has the shape that is read here."""


def check_contract(payloads: DataFrame, payload: str = "payload") -> None:
    """Fail if any non-empty payload lacks the list of matches, or if none of its matches has a wine id."""
    parsed = F.from_json(payload, PAYLOAD)
    bad = (F.get_json_object(payload, "$.explore_vintage.matches").isNull() | ~F.trim(F.get_json_object(payload, "$.explore_vintage.matches")).startswith("["))
    empty = F.trim(F.col(payload)).isin("", "{}")
    unread = (F.size(parsed["explore_vintage"]["matches"]) > 0) & ~F.exists(parsed["explore_vintage"]["matches"], lambda m: m["vintage"]["wine"]["id"].isNotNull())
    row = payloads.agg(F.count_if(~empty & bad).alias("bad"), F.count_if(F.coalesce(unread, F.lit(False))).alias("unread")).first()
    if row["bad"] or row["unread"]:
        raise BrokenContract(f"{row['bad']} payloads without matches, {row['unread']} of which none can be read")


def tastes(structure: Column) -> Column:
    """Map of the axes that say something, with the number of judgments; null if there are none."""
    entry = lambda k: F.when(structure[k] > 0, F.struct(F.lit(k).alias("k"), structure[k].alias("v")))
    count = F.when(structure["user_structure_count"] > 0, F.struct(F.lit("count").alias("k"), structure["user_structure_count"].cast("double").alias("v")))
    axes = F.filter(F.array(*(entry(k) for k in TASTES)), lambda e: e.isNotNull())
    return F.when(F.size(axes) > 0, F.map_from_entries(F.concat(axes, F.filter(F.array(count), lambda e: e.isNotNull()))))


def shop_prices(prices: Column) -> Column:
    """Francs per reference bottle of each shop price; other currencies are left out."""
    units = lambda p: F.coalesce(F.nullif(p["bottle_quantity"], F.lit(0)), F.lit(1))
    ml = lambda p: F.coalesce(F.nullif(p["bottle_type"]["volume_ml"], F.lit(0)), F.lit(P.REFERENCE_ML))
    kept = F.filter(F.coalesce(prices, F.array().cast(f"array<{PRICE}>")), lambda p: (F.upper(p["currency"]["code"]) == "CHF") & (p["amount"] > 0) & (units(p) > 0) & (ml(p) > 0))
    return F.transform(kept, lambda p: F.struct(F.round(p["amount"] / units(p) * (F.lit(float(P.REFERENCE_ML)) / ml(p)), 2).alias("per_75cl"), p["amount"].alias("raw"), p["url"].alias("url")))


def entries(payloads: DataFrame, payload: str = "payload", page: str = "https://ratings.example/{slug}/w/{id}") -> DataFrame:
    """Catalog entries of search payloads, one per wine and year."""
    head, tail = page.split("{slug}")
    m = payloads.select(F.explode(F.from_json(payload, PAYLOAD)["explore_vintage"]["matches"]).alias("m")).select("m.*")
    v, w, s = F.col("vintage"), F.col("vintage.wine"), F.col("vintage.statistics")
    positive = lambda c: F.when(c > 0, c)
    slug = F.coalesce(w["seo_name"], v["seo_name"], F.lit("wine"))
    rows = m.where(w["id"].isNotNull()).select(
        w["id"].alias("wine_id"), F.coalesce(v["name"], w["name"], F.lit("")).alias("name"), F.coalesce(w["name"], F.lit("")).alias("wine_name"), F.coalesce(w["winery"]["name"], F.lit("")).alias("winery"),
        F.concat(F.lit(head), slug, F.lit(tail.split("{id}")[0]), w["id"]).alias("url"), v["year"].try_cast("int").alias("year"),
        positive(s["ratings_average"]).alias("vintage_avg"), F.coalesce(s["ratings_count"], F.lit(0)).alias("vintage_count"), positive(s["wine_ratings_average"]).alias("wine_avg"), F.coalesce(s["wine_ratings_count"], F.lit(0)).alias("wine_count"),
        positive(w["type_id"]).alias("type_id"), w["winery"]["seo_name"].alias("winery_slug"), w["style"]["name"].alias("style_name"), w["region"]["country"]["name"].alias("country"), w["region"]["name"].alias("region_name"),
        tastes(w["taste"]["structure"]).alias("taste"), tastes(w["style"]["baseline_structure"]).alias("style_baseline"),
        shop_prices(F.filter(F.concat(F.coalesce(F.col("prices"), F.array().cast(f"array<{PRICE}>")), F.array("price")), lambda p: p.isNotNull())).alias("prices"))
    key = F.concat_ws("|", "wine_id", F.coalesce(F.col("year").cast("string"), F.lit("")))
    return rows.withColumn("entry_id", key).dropDuplicates(["entry_id"]).withColumn("rated", (F.col("vintage_count") >= MIN_RATINGS) & F.col("vintage_avg").isNotNull())


def display_name(entry: Column) -> Column:
    """Wine name with its winery in front unless it holds it."""
    return F.when((entry["winery"] == "") | F.lower(entry["wine_name"]).contains(F.lower(entry["winery"])), entry["wine_name"]).otherwise(F.concat_ws(" ", entry["winery"], entry["wine_name"]))


def drinking_window(html: Column) -> Column:
    """``struct(first, last)`` of years that a page states; null years stay null."""
    return F.struct(F.regexp_extract(html, WINDOW, 1).try_cast("int").alias("first"), F.regexp_extract(html, WINDOW, 2).try_cast("int").alias("last"))


def critic_points(text: Column) -> Column:
    """Points from 50 to 100 that a critic's page states beside its word for them."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?iu)(\d{2,3})(?:[.,]\d)?\s*(?:\+)?\s*(?:punkte|points|/\s*100)", 1)
    return let(found.try_cast("double"), lambda p: F.when(p.between(*POINTS), p))


def same_house_only(rows: DataFrame) -> DataFrame:
    """Producer-page entries that share a distinctive word with the name which is not the producer's.

    ``rows`` have ``name, entry`` (a struct): who builds the pool by the producer
    may not count the producer as evidence.
    """
    shared = F.array_intersect(X.distinctive_tokens(F.col("name")), X.distinctive_tokens(display_name(F.col("entry"))))
    return rows.where(F.size(F.array_except(shared, X.distinctive_tokens(F.col("entry.winery")))) > 0)
