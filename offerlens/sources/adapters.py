"""From raw records of shops to offers: one constructor, and the rules that single shops need.

A shop is described by where its records lie (tiles of a page, objects of a
payload, rows of a leaflet) and by which of these rules apply; the records of all
shops then go through ``make_offers``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prices as P, text as X
from ..operators.merge import dedupe_offers
from ..operators.small import attach

# Fixed values.
UNIT_TOLERANCE, PERCENT_TOLERANCE = 0.02, 1.0
BOTTLES = (2, 24)
MERCHANT_SLUG = r"[^a-z0-9]+"


@dataclass
class Shop:
    """What ``make_offers`` needs to know about a source."""

    key: str
    price_basis: str = "auto"
    vat_included: bool = True
    private_labels: list[str] = field(default_factory=list)
    allow: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    critics: dict[str, str] = field(default_factory=dict)


OPTIONAL = {"url": "string", "reference": "double", "basis_text": "string", "vintage": "int", "producer": "string", "region": "string", "article": "string", "seller": "string", "vat": "boolean", "position": "int", "sure": "boolean", "pack": "int", "critic_text": "string", "note": "string"}


def build_offers(raw: DataFrame, shop: Shop) -> DataFrame:
    """Offers of ``raw(name, amount, ...)``; what is missing of ``OPTIONAL`` is null.

    The reference price is brought to the same unit by the factor that was
    applied to the price, so that the discount compares like with like. A record
    that is not ``sure`` of what its amount pays for has a low confidence; ``pack``
    is a number of bottles that the shop states beside the price of one.
    """
    raw = raw.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in raw.columns})
    basis = F.concat_ws(" ", "name", "basis_text")
    rows = P.with_normalized_price(raw.where(F.coalesce(F.trim("name"), F.lit("")) != ""), "amount", basis, "p", F.col("vat"), shop.price_basis, shop.vat_included)
    if shop.allow or shop.deny:
        rows = rows.where(X.looks_like(F.col("name"), shop.allow, shop.deny))
    reference = P.cents(F.col("reference") * F.try_divide(F.col("p.price"), F.col("amount")))
    percent = P.discount_percent(F.col("p.price"), reference)
    private = X.private_label(F.col("name"), shop.private_labels)
    vintage = F.coalesce("vintage", X.extract_vintage(F.col("name")))
    out = rows.select(
        F.lit(shop.key).alias("source"), F.coalesce("seller", F.lit(shop.key)).alias("seller"), F.trim("name").alias("name"), "url", vintage.alias("vintage"), "producer", "region",
        F.col("p.price").alias("price"), F.col("p.raw").alias("raw"), F.when(F.col("sure") == F.lit(False), "low").otherwise(F.col("p.confidence")).alias("confidence"), F.col("p.bottle_ml").alias("bottle_ml"), F.coalesce("pack", "p.units").alias("units"),
        F.col("p.vat_added").alias("vat_added"), F.col("p.raw_is_pack").alias("raw_is_pack"), reference.alias("reference_price"), percent.alias("discount_percent"),
        P.rate_discount(percent, private).alias("discount_plausibility"), private.alias("private_label"), F.col("article").alias("article"),
        X.critic_scores(F.concat_ws(" ", basis, "critic_text"), shop.critics).alias("critics") if shop.critics else F.lit(None).cast("map<string,double>").alias("critics"),
        X.normalized_name(F.col("name")).alias("normalized_name"), X.dedup_key(F.col("name"), vintage).alias("dedup_key"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce("position", F.lit(0)).alias("position"))
    return out


def make_offers(raw: DataFrame, shop: Shop) -> DataFrame:
    """``build_offers`` of a source's records, one per name and vintage."""
    return dedupe_offers(build_offers(raw, shop))


def not_expired(text: Column, today: Column) -> Column:
    """False if the last date ``d.m.yyyy`` of a text has passed; unreadable texts stay."""
    last = F.element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d{1,2}\.\d{1,2}\.\d{4})"), F.lit(1)), -1)
    end = F.try_to_timestamp(F.when(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d{1,2}\.\d{1,2}\.\d{4})"), F.lit(1))) > 0, last), F.lit("d.M.yyyy"))
    return F.coalesce(end.cast("date") >= today, F.lit(True))


def merchant_key(label: Column, known: dict[str, str]) -> Column:
    """Key of a merchant's label: the known one, else a slug of ASCII letters and digits."""
    t = X.fold(F.trim(label))
    named = F.coalesce(*(F.when(t == k, v) for k, v in known.items()), F.lit(None).cast("string"))
    return F.coalesce(named, F.nullif(F.regexp_replace(t, MERCHANT_SLUG, ""), F.lit("")))


def deep_link(base: Column, name: Column, words: int = 3) -> Column:
    """A shop's search address with the first query words in ``q``."""
    return F.concat(base, F.when(base.contains("?"), "&q=").otherwise("?q="), F.url_encode(F.array_join(F.slice(X.query_tokens(name), 1, words), " ")))


def unit_price_agrees(amount: Column, ml: Column, per_litre: Column, other: Column | None = None) -> Column:
    """Whether a stated price per litre fits the amount (or another one, such as the list price) within two percent."""
    fits = lambda a: F.abs(a * 1000.0 / ml - per_litre) <= UNIT_TOLERANCE * per_litre
    ok = F.coalesce(fits(amount), F.lit(False))
    return F.coalesce(per_litre.isNull(), F.lit(False)) | ok | (F.coalesce(fits(other), F.lit(False)) if other is not None else F.lit(False))


def strike_price(candidates: Column, amount: Column, percent: Column) -> Column:
    """The first list price that gives the advertised percentage within one point."""
    return F.get(F.filter(candidates, lambda c: (c > amount) & (F.abs((1 - amount / c) * 100 - percent) <= PERCENT_TOLERANCE)), F.lit(0))


def amounts(text: Column) -> Column:
    """All amounts of a text with two decimals."""
    found = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "['’]", ""), F.lit(r"(\d+[.,]\d{2})(?!\d)"), F.lit(1))
    return F.transform(found, lambda a: F.regexp_replace(a, ",", ".").cast("double"))


def now_and_before(text: Column, word: str = "statt") -> Column:
    """``struct(amount, reference)`` of a box with at least two amounts and a word that announces the old one."""
    a = amounts(text)
    ok = (F.size(a) >= 2) & F.lower(text).contains(word)
    return F.when(ok, F.struct(F.array_min(a).alias("amount"), F.array_max(a).alias("reference")))


def below_reference(prices: Column, reference: Column) -> Column:
    """Least amount under a struck price; null without one."""
    return F.array_min(F.filter(prices, lambda p: p < reference))


def size_in_parentheses(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\((\d+(?:[.,]\d+)?\s*(?:cl|dl|ml|l))\)", 1), F.lit(""))


def strip_origin(name: Column, regions: list[str]) -> Column:
    """Name without a leading region and separator."""
    return F.regexp_replace(name, r"(?i)^(?:" + "|".join(sorted(map(r"\Q{}\E".format, regions), key=len, reverse=True)) + r")\s*[,:–-]\s*", "")


def bottles_from_url(url: Column) -> Column:
    """Sum of the ``NxYYYY`` parts of an address, if plausible."""
    n = F.aggregate(F.regexp_extract_all(url, F.lit(r"(?<!\d)(\d{1,2})x\d{4}"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(n.between(*BOTTLES), n)


def producer_from_url(url: Column, name: Column) -> Column:
    """Up to three words of an address's last part that the name lacks."""
    slug = F.regexp_replace(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1), r"\.\w+$", "")
    words = F.filter(F.split(X.fold(slug), r"[^a-z]+"), lambda w: F.length(w) > 2)
    extra = F.array_except(words, X.tokenize_keep_producer(name))
    return F.nullif(F.initcap(F.array_join(F.slice(extra, 1, 3), " ")), F.lit(""))


def one_level(variant_json: Column, path: str) -> Column:
    """Elements of a JSON array as strings."""
    return F.from_json(F.get_json_object(variant_json, path), "array<string>")


def seed_ratings(hits: DataFrame) -> DataFrame:
    """Rating rows that marketplace records bring along: exact by construction, drinking window not yet looked up."""
    rated = hits.where("rating IS NOT NULL AND rating_count > 0")
    return rated.select("normalized_name", "vintage", "rating", "rating_count", "entity_url", F.lit("exact").alias("status"), F.lit("exact").alias("confidence"), F.lit(False).alias("window_checked")).dropDuplicates(["normalized_name", "vintage"])


def search_words(name: Column, words: int = 3) -> Column:
    """The first query words of a name up to its first dash."""
    head = F.substring_index(F.substring_index(name, "–", 1), " - ", 1)
    return F.array_join(F.slice(X.query_tokens(head), 1, words), " ")


def with_search(url: Column, words: Column) -> Column:
    """A shop's address with ``words`` in front of what its ``q`` filters by; an address without ``q`` gets the usual order."""
    query = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    old = F.get(F.filter(query, lambda p: p.startswith("q=")), F.lit(0))
    filters = F.regexp_extract(F.coalesce(F.url_decode(F.substring(old, 3, 10_000)), F.lit(":relevance:specialOfferFacet:true")), r"^[^:]*:(.*)$", 1)
    rest = F.filter(query, lambda p: (p != "") & ~p.startswith("q="))
    asked = F.concat(F.lit("q="), F.replace(F.url_encode(F.concat(words, F.lit(":"), F.when(filters == "", "relevance").otherwise(filters))), F.lit("+"), F.lit("%20")))
    return F.when(words == "", url).otherwise(F.concat(F.substring_index(url, "?", 1), F.lit("?"), F.array_join(F.concat(F.array(asked), rest), "&")))


def promo_page(name: Column, pages: dict[str, str]) -> Column:
    """Where a merchant sells a name: its standard page searched for the name, else the page of a colour that the name says."""
    standard, words = pages.get("standard"), search_words(name)
    by_colour = F.coalesce(*(F.when(F.lower(name).contains(colour), url) for colour, url in pages.items() if colour != "standard"), F.lit(standard).cast("string"))
    return F.when(words != "", with_search(F.lit(standard), words)).otherwise(by_colour) if standard else by_colour


def marketplace(hits: DataFrame) -> DataFrame:
    """Marketplace records that are real markdowns of standard bottles, one per price id."""
    ok = (F.col("bottle_ml") == P.REFERENCE_ML) & (F.col("amount") > 0) & (F.col("discounted_from") > F.col("amount"))
    return hits.where(ok).dropDuplicates(["price_id"]).withColumn("reference", F.col("discounted_from"))


def first_answer(sources: list[DataFrame]) -> DataFrame:
    """The first source that has rows, decided in one plan: later ones count only while all before them are empty."""
    out = sources[0]
    for s in sources[1:]:
        seen = out.limit(1).select(F.lit(True).alias("_any"))
        out = out.unionByName(s.join(F.broadcast(seen), F.lit(True), "left_anti"), allowMissingColumns=True)
    return out


def require(rows: DataFrame, columns: list[str], share: float = 0.5) -> DataFrame:
    """Fail if a payload no longer has what it used to: a required column that is null in most rows is a broken contract."""
    row = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in columns)).first()
    broken = [c for c in columns if row["n"] and row[c] < share * row["n"]]
    if broken:
        raise ValueError(f"payload lacks {', '.join(broken)}")
    return rows
