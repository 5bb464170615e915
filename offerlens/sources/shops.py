"""Records of single shops, read from landed pages and payloads, as what ``adapters.make_offers`` takes.

Every reader takes ``pages(url, html)`` or ``payloads(url, payload)`` and gives raw
records: it knows where a shop states name, amount, struck price, size and vintage,
and which records are no offers. Tiles go through the page parser; JSON stays in
the JVM. ``tile_balance`` and ``claimed_total`` say what a reader could not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import prices as P, text as X
from ..functions.bind import let
from . import adapters as A, pages as H
from .adapters import Shop

# Fixed values.
MERCHANTS = {"coop": "coop", "coop megastore": "coop", "coop bau+hobby": "coop", "denner": "denner", "denner express": "denner", "migros": "migros", "migrolino": "migros",
             "otto's": "ottos", "ottos": "ottos", "lidl": "lidl", "aldi": "aldi", "aldi suisse": "aldi", "spar": "spar", "volg": "volg", "landi": "landi", "globus": "globus", "manor": "manor"}
WINE_GROUPS = ["flaschenweine", "vins en bouteille", "vins en bouteilles", "offenweine", "vins ouverts", "vin ouvert"]
OTHER_GROUPS = ["biere und mostgetränke", "bières et cidres", "bières et boissons au moût", "alkoholfreie getränke", "boissons sans alcool", "spirituosen", "spiritueux", "verschiedenes", "divers"]
OTHER_SUBGROUPS = ["degustationkarton", "degustationskarton", "carton de dégustation", "ohne alkohol", "sans alcool"]
WINE_CATEGORIES = ["wein", "weine", "schaumwein", "champagne", "spirituosen"]
STANDARD_BOTTLE = 1
CENTS, SIZE_PER_ML = 100.0, 10
YEAR = r"(?<!\d)(19[5-9]\d|20[0-4]\d)(?!\d)"
TEXT = "struct<de:struct<{f}>,fr:struct<{f}>>"
MAX_PAGES = 40


def _words(c: Column) -> Column:
    """A text without markup's white space; "" for none."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _amount(c: Column) -> Column:
    """A positive amount, from text or number; null otherwise."""
    value = F.regexp_replace(F.regexp_replace(c.cast("string"), "['’]", ""), ",", ".").try_cast("double")
    return F.when(value > 0, value)


def _joined(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *(F.nullif(_words(p), F.lit("")) for p in parts)))


def _holds(name: Column, producer: Column) -> Column:
    """Whether all longer words of a producer stand in a name."""
    return let(F.filter(X.tokenize(producer), lambda w: F.length(w) > 2), lambda ws: (F.size(ws) > 0) & (F.size(F.array_except(ws, X.tokenize(name))) == 0))


def _with_producer(name: Column, producer: Column) -> Column:
    return F.when((producer == "") | _holds(name, producer), name).otherwise(_joined(name, producer))


def _year(text: Column, last: bool = False) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(1))
    return (F.element_at(F.when(F.size(found) > 0, found), -1) if last else F.get(found, F.lit(0))).cast("int")


def _chf(text: Column) -> Column:
    """All amounts beside a word for francs, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?:(?:CHF|Fr\.?)\s*([\d'’.,]+)|([\d'’.,]+)\s*(?:CHF|Fr\.?))"), F.lit(0))
    return F.filter(F.transform(found, lambda t: X.parse_price(t)), lambda p: p.isNotNull())


def _struck(text: Column) -> Column:
    """The amount behind ``statt``."""
    return X.parse_price(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)statt\s*(?:CHF|Fr\.?)?\s*([\d'’.,]+)", 1), F.lit("")))


def _absolute(rows: DataFrame, href: str = "href", base: str = "url") -> DataFrame:
    return rows.withColumn("url", H.absolute_url(F.col(base), F.col(href)))


def aggregator(pages: DataFrame, today: Column, sites: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Cards of many merchants' deals: expired ones and those without merchant or price go; a merchant's own promotion page replaces the link."""
    cards = H.tiles(pages, "div.card.dealtype-deal", {
        "full": "div.card-image img@alt|a[title]@title|h3.card-title", "label": "div.card-merchant img@alt", "now": "span.price-new", "before": "span.price-old", "href": "a@href",
        "meta": "p.card-meta|div.card-meta|p.card-description|div.card-content", "until": "span.card-date", "article": "@data-upox-id"}, keep=["url"])
    name = _words(F.regexp_replace("full", r"(?i)^\s*Mehr\s+Infos\s+über\s+", ""))
    rows = _absolute(cards.where(A.not_expired(F.col("until"), today)).withColumns({"name": name, "seller": A.merchant_key(_words(F.col("label")), MERCHANTS), "amount": X.parse_price(F.col("now")), "reference": X.parse_price(F.col("before"))}))
    rows = rows.where("name <> '' AND seller IS NOT NULL AND amount IS NOT NULL").withColumns({"basis_text": F.coalesce(F.nullif("meta", F.lit("")), F.col("all_text")), "note": F.concat_ws(" ", F.lit("valid"), F.nullif("until", F.lit("")))})
    for merchant, own in (sites or {}).items():
        rows = rows.withColumn("url", F.when(F.col("seller") == merchant, F.coalesce(A.promo_page(F.col("name"), own), "url")).otherwise(F.col("url")))
    return rows.select("name", "seller", "amount", "reference", "basis_text", "url", "article", "note", "position")


_WHOLESALE = ("struct<sKU:string,packagingLabel:string,packagingLabelPro:string,quantityUnit:struct<code:string,number:int>,quantityUnitBase:struct<code:string>,href:struct<self:string>,"
              "article:struct<articleNumber:string,articleGroup:struct<translations:" + TEXT.format(f="wording:string") + ">>,translations:"
              + TEXT.format(f="advertisingText:string,additionalDesignation:string,brand:string,description:string,weightVolume:string")
              + ",mainArticleDetailPrice:struct<salesPriceTTC:double,discountPriceTTC:double>>")


def wholesaler(pages: DataFrame) -> DataFrame:
    """Articles in an attribute's JSON: the amount pays for the pack, and an unknown pack makes the price unsure. One row per article."""
    payload = H.unescape(F.regexp_extract("html", r'pagination="([^"]{200,})"', 1))
    items = pages.select(F.explode(F.from_json(payload, f"struct<items:array<{_WHOLESALE}>>")["items"]).alias("i")).select("i.*")
    said = lambda f: F.coalesce(F.nullif(_words(F.col(f"translations.de.{f}")), F.lit("")), F.nullif(_words(F.col(f"translations.fr.{f}")), F.lit("")))
    head = _joined(said("advertisingText"), said("additionalDesignation"))
    full = let(F.struct(head.alias("h"), said("brand").alias("b")), lambda x: F.when(x["b"].isNull() | F.lower(x["h"]).contains(F.lower(x["b"])), x["h"]).otherwise(_joined(x["h"], x["b"])))
    named = let(full, lambda n: F.when(n != "", n).otherwise(F.coalesce(said("description"), F.lit(""))))
    volume = F.coalesce(F.nullif(_words(F.col("packagingLabel")), F.lit("")), said("weightVolume"))
    name = let(F.struct(named.alias("n"), volume.alias("v")), lambda x: F.when(x["v"].isNull() | (x["n"] == "") | F.lower(x["n"]).contains(F.lower(x["v"])), x["n"]).otherwise(F.concat_ws(", ", x["n"], x["v"])))
    count = F.when(F.col("quantityUnit.number") > 0, F.col("quantityUnit.number")).when(F.col("quantityUnit").isNull() & (F.col("quantityUnitBase.code") == "BT"), 1)
    gross, regular = F.col("mainArticleDetailPrice.discountPriceTTC"), F.col("mainArticleDetailPrice.salesPriceTTC")
    each = lambda c: F.when(F.col("pack").isNull(), c).otherwise(F.round(c / F.col("pack"), 2))
    rows = items.where(gross.isNotNull()).withColumns({"name": name, "pack": count}).where("name <> ''")
    group = F.coalesce(F.nullif("article.articleGroup.translations.de.wording", F.lit("")), F.col("article.articleGroup.translations.fr.wording"))
    return rows.select(
        "name", each(gross).alias("amount"), each(F.nullif(regular, F.lit(0.0))).alias("reference"), F.when(F.col("pack").isNull(), F.coalesce("packagingLabelPro", F.lit(""))).otherwise(F.coalesce("packagingLabel", F.lit(""))).alias("basis_text"),
        F.col("pack").isNotNull().alias("sure"), "pack", F.col("href.self").alias("url"), F.col("article.articleNumber").alias("article"), group.alias("category"), F.coalesce("sKU", "name").alias("_sku")).dropDuplicates(["_sku"]).drop("_sku")


_ATTRIBUTES = "struct<sku:string,price:string,attributeInfo:array<struct<attributeName:string,vals:array<struct<value:string,label:string>>>>>"


def flat_attributes(product: Column) -> Column:
    """``struct(values, labels)`` of a product's attribute list: the first value of each name, and all its labels."""
    live = F.filter(product["attributeInfo"], lambda a: a["attributeName"].isNotNull() & (F.size(a["vals"]) > 0))
    # of a repeated name the last entry counts
    last = lambda xs: F.filter(xs, lambda a, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda b: b["attributeName"] == a["attributeName"]))
    return let(last(live), lambda xs: F.struct(
        F.map_from_entries(F.transform(xs, lambda a: F.struct(a["attributeName"], a["vals"][0]["value"]))).alias("values"),
        F.map_from_entries(F.transform(xs, lambda a: F.struct(a["attributeName"], F.filter(F.transform(a["vals"], lambda v: v["label"]), lambda t: t.isNotNull() & (t != ""))))).alias("labels")))


def discounter(pages: DataFrame, marker: str = "__NUXT_DATA__") -> DataFrame:
    """Products of a server-side-rendered index graph: in a wine category; a pack is its box count times its size."""
    found = pages.select("url", F.explode(H.graph_objects(H.script_payload(F.col("html"), marker), ["sku", "attributeInfo"])).alias("o")).withColumn("p", F.from_json("o", _ATTRIBUTES))
    rows = found.withColumn("a", flat_attributes(F.col("p")))
    v = lambda k: F.coalesce(F.col("a.values")[k], F.lit(""))
    box = F.trim(v("box_item_count"))
    size = F.trim(v("content_size_text"))
    basis = F.when(size == "", v("nameSubline")).when(box.isin("", "0", "1"), size).otherwise(F.concat_ws(" × ", box, size))
    category = F.lower(F.array_join(F.coalesce(F.col("a.labels")["category"], F.array().cast("array<string>")), " "))
    rows = rows.where((v("name") != "") & F.exists(F.array(*map(F.lit, WINE_CATEGORIES)), lambda c: category.contains(c))).withColumn("href", v("itemUrl"))
    rows = _absolute(rows).select(
        v("name").alias("name"), X.parse_price(F.coalesce(F.nullif(v("priceFormatted"), F.lit("")), F.nullif(v("price"), F.lit("")), F.col("p.price"))).alias("amount"), X.parse_price(v("insteadPriceText")).alias("reference"),
        basis.alias("basis_text"), "url", F.coalesce(F.nullif(v("pimcoreId"), F.lit("")), F.col("p.sku")).alias("article"), F.concat_ws("; ", F.nullif(v("promotionLabel"), F.lit("")), F.nullif(v("product_publication"), F.lit(""))).alias("note"), F.col("p.sku").alias("_sku"))
    return rows.withColumn("_sku", F.coalesce(F.nullif("_sku", F.lit("")), F.concat_ws("|", "name", "url"))).dropDuplicates(["_sku"]).drop("_sku")


_API = ("array<struct<name:map<string,string>,slug:map<string,string>,masterVariant:struct<sku:string,published:boolean,active:boolean,url:string,price:struct<initialPrice:struct<amount:double>,discountPrice:struct<amount:double>,literPrice:struct<amount:double>>,"
        "attributes:struct<name:map<string,string>,producer:map<string,string>,bottleSize:double>>>>")


def api_shop(payloads: DataFrame, language: str = "de", base: str = "https://shop.example/") -> DataFrame:
    """Products of a shop's own interface: only those that live, have a struck price and a size that the price per litre confirms; amounts are cents."""
    said = lambda m: F.coalesce(F.nullif(_words(F.coalesce(m[language + "-CH"], m[language])), F.lit("")), F.lit(""))
    rows = payloads.select(F.explode(F.from_json("payload", _API)).alias("p")).select("p.*")
    v = F.col("masterVariant")
    rows = rows.where(F.coalesce(v["published"] & v["active"], F.lit(False))).withColumns({
        "amount": v["price"]["discountPrice"]["amount"] / CENTS, "reference": v["price"]["initialPrice"]["amount"] / CENTS, "_ml": F.floor(v["attributes"]["bottleSize"] / SIZE_PER_ML).cast("int"),
        "_name": F.coalesce(F.nullif(said(F.col("name")), F.lit("")), said(v["attributes"]["name"]))}).where("amount > 0 AND reference > amount AND _name <> ''")
    ok = A.unit_price_agrees(F.col("amount"), F.col("_ml"), F.nullif(v["price"]["literPrice"]["amount"], F.lit(0.0)))
    slug = F.coalesce(F.nullif(said(F.col("slug")), F.lit("")), F.regexp_replace(F.coalesce(v["url"], F.lit("")), r"^/+|\?.*$", ""))
    return rows.select(_joined(F.col("_name"), said(v["attributes"]["producer"])).alias("name"), "amount", "reference", F.when(ok & (F.col("_ml") > 0), F.concat("_ml", F.lit(" ml"))).otherwise("").alias("basis_text"),
                       F.when(slug != "", F.concat(F.lit(f"{base}{language}/"), slug)).otherwise(base).alias("url"), v["sku"].alias("article"), F.lit(True).alias("vat"))


_TILE = ("struct<id:string,name:string,description:string,extraDescription:string,isSellable:boolean,isTemporarilyUnavailable:boolean,isSellableByUnit:boolean,hasDeliveryDelay:boolean,conditioningDetail:struct<capacity:double>,"
         "packaging:struct<unit:string,main:string>,packagingDetails:map<string,struct<quantity:int,isSellable:boolean>>,price:map<string,string>,insteadOfPrice:map<string,string>,"
         "promotion:struct<percent:string,regularPrice:map<string,string>>,gAData:struct<items:array<struct<item_category:string,item_category2:string>>>>")
_TILE_JSON = r'x-data="product\((\{[^"]*\})\)"'


def _tile_json(pages: DataFrame) -> DataFrame:
    found = F.explode(F.transform(F.regexp_extract_all("html", F.lit(_TILE_JSON), F.lit(1)), H.unescape))
    return pages.select("url", found.alias("o")).withColumn("p", F.from_json("o", _TILE))


def tile_shop(pages: DataFrame, link: str = "") -> DataFrame:
    """JSON tiles: sold by the bottle or by the carton, category before words; the struck price is the list price that gives the advertised percentage."""
    rows = _tile_json(pages).select("url", "p.*")
    group, sub = (F.lower(F.trim(F.coalesce(F.col("gAData.items")[0][k], F.lit("")))) for k in ("item_category", "item_category2"))
    rows = rows.where(~sub.isin(*OTHER_SUBGROUPS) & ~group.isin(*OTHER_GROUPS) & F.coalesce("isSellable", F.lit(True)) & ~F.coalesce("isTemporarilyUnavailable", F.lit(False)) & (F.col("conditioningDetail.capacity") > 0))
    single = F.coalesce("isSellableByUnit", F.lit(False)) & F.coalesce(F.col("packagingDetails")[F.col("packaging.unit")]["isSellable"], F.lit(True))
    rows = rows.withColumns({"_single": single}).withColumn("_key", F.when(F.col("_single"), F.col("packaging.unit")).otherwise(F.col("packaging.main")))
    count = F.col("packagingDetails")[F.col("_key")]["quantity"]
    size = F.concat(X.format_number(F.col("conditioningDetail.capacity")), F.lit(" cl"))
    rows = rows.withColumns({"amount": _amount(F.col("price")[F.col("_key")]), "_list": _amount(F.col("insteadOfPrice")[F.col("_key")]), "_regular": _amount(F.col("promotion.regularPrice")[F.col("_key")]), "_percent": F.col("promotion.percent").try_cast("double")}).where("amount IS NOT NULL")
    options = F.filter(F.array("_list", "_regular"), lambda c: c > F.col("amount"))
    struck = F.when(F.col("promotion").isNull(), None).when(F.col("_percent").isNull(), F.get(options, F.lit(0))).otherwise(A.strike_price(options, F.col("amount"), F.col("_percent")))
    extra = lambda shown, more: F.when((more == "") | F.lower(shown).contains(F.lower(more)), shown).otherwise(F.concat_ws(" ", shown, more))
    name = let(extra(_words(F.col("name")), _words(F.col("extraDescription"))), lambda n: extra(n, _words(F.col("description"))))
    words = F.split("id", r"\s+")
    url = H.absolute_url(F.col("url"), F.replace(F.lit(link), F.lit("0"), F.replace(F.url_encode("id"), F.lit("+"), F.lit("%20")))) if link else F.col("url")
    return rows.select(
        F.trim(name).alias("name"), "amount", struck.alias("reference"), F.when(F.col("_single"), F.concat(F.lit("1 x "), size)).otherwise(F.concat(F.lit("Karton "), F.when(count > 0, count).otherwise(1).cast("string"), F.lit(" x "), size)).alias("basis_text"),
        F.when(F.col("_single"), "bottle").otherwise("pack").alias("basis"), url.alias("url"), F.col("id").alias("article"), F.when(F.get(words, F.lit(2)).rlike(r"^(?:19|20)\d\d$"), F.get(words, F.lit(2)).cast("int")).alias("vintage"),
        F.concat_ws("; ", F.when(F.col("promotion").isNull(), "no promotion stated"), F.when(~F.col("_single"), "only by the carton"), F.when(F.coalesce("hasDeliveryDelay", F.lit(False)), "delivery delayed")).alias("note"))


def tile_balance(pages: DataFrame) -> DataFrame:
    """Per page: tiles that its markup announces, those that were read, and those whose JSON is broken."""
    tiles = _tile_json(pages).groupBy("url").agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("p").isNull() | (F.col("p.id").isNull() & F.col("p.name").isNull())).alias("broken"))
    expected = pages.select("url", F.regexp_count("html", F.lit(r'x-data="product\(')).alias("expected"))
    return expected.join(tiles, "url", "left").na.fill(0, ["read", "broken"]).withColumn("missed", F.col("expected") - F.col("read"))


_NESTED = "struct<title1:string,title2:string,title3:string,price:double,oldPrice:double,slug:string,sku:string,size:struct<name:string>,year:struct<name:string>>"


def nested_shop(payloads: DataFrame, base: str = "https://shop.example/") -> DataFrame:
    """Products anywhere in a payload, known by their struck price and packaging."""
    rows = payloads.select(F.explode(H.embedded_objects(F.col("payload"), ["oldPrice", "packaging"])).alias("o")).select(F.from_json("o", _NESTED).alias("p")).select("p.*")
    one, two, three = (_words(F.col(f"title{k}")) for k in (1, 2, 3))
    name = F.when(three != "", _joined(three, one)).otherwise(_joined(one, two))
    size = _words(F.col("size.name"))
    return rows.where("price > 0 AND oldPrice > price").withColumn("name", name).where("name <> ''").select(
        "name", F.col("price").alias("amount"), F.col("oldPrice").alias("reference"), _joined(size, F.col("name")).alias("basis_text"), F.when(_words(F.col("slug")) != "", F.concat(F.lit(base), F.trim("slug"), F.lit("/p"))).otherwise("").alias("url"),
        F.col("sku").alias("article"), F.when(F.col("year.name").rlike(r"^\d+$"), F.col("year.name").try_cast("int")).alias("vintage"), F.lit(True).alias("vat"))


def claimed_total(payloads: DataFrame) -> DataFrame:
    """``url, total``: the greatest count that a list in a payload states for itself."""
    found = payloads.select("url", F.explode_outer(H.embedded_objects(F.col("payload"), ["count", "data"])).alias("o"))
    stated = F.when(F.get_json_object("o", "$.data").startswith("["), F.get_json_object("o", "$.count").try_cast("int"))
    return found.groupBy("url").agg(F.coalesce(F.max(stated), F.lit(0)).alias("total"))


def cellar(pages: DataFrame) -> DataFrame:
    """Tiles with a special and a regular price; sets state their bottles, and producers stand in the address."""
    t = H.tiles(pages, "li.product-item", {"name": "a.product-item-link", "href": "a.product-item-link@href", "attributes": ".cs-product-tile__attribute*", "points": ".cs-product-tile__attributes-item-value*",
                                           "special": ".special-price", "regular": ".old-price", "box": "div.price-box"}, keep=["url"]).where("name <> ''")
    francs = F.transform(F.regexp_extract_all("box", F.lit(r"CHF\s*[\d'’.,]+"), F.lit(0)), X.parse_price)
    two = F.lower("box").contains("sonderpreis") & (F.size(francs) >= 2)
    t = t.withColumns({"amount": F.coalesce(X.parse_price(F.col("special")), F.get(francs, F.lit(0))), "_old": F.coalesce(X.parse_price(F.col("regular")), F.when(two, F.get(francs, F.lit(1))))}).where("amount IS NOT NULL")
    t = _absolute(t.withColumn("_page", F.col("url")), base="_page")
    producer, bottles = A.producer_from_url(F.col("url"), F.col("name")), A.bottles_from_url(F.col("url"))
    return t.select(F.when(producer.isNull(), F.col("name")).otherwise(F.concat("name", F.lit(" ("), producer, F.lit(")"))).alias("name"), "amount", F.when(F.col("_old") > F.col("amount"), F.col("_old")).alias("reference"),
                    F.when(bottles.isNull(), F.col("attributes")).otherwise(F.concat("attributes", F.lit(" Karton "), bottles, F.lit(" x 75 cl"))).alias("basis_text"), "url", _year(F.concat_ws(" ", "name", "attributes")).alias("vintage"),
                    F.col("points").alias("critic_text"), F.substring("attributes", 1, 160).alias("note"), "position")


def last_page(pages: DataFrame) -> DataFrame:
    """``url, last``: pages of a list as its pager says, at most ``MAX_PAGES``."""
    told = H.tiles(pages, "input", {"role": "@data-role", "most": "@max"}, keep=["url"]).where("role = 'pager'").groupBy("url").agg(F.max(F.col("most").try_cast("int")).alias("n"))
    return pages.select("url").join(told, "url", "left").select("url", F.least(F.coalesce("n", F.lit(MAX_PAGES)), F.lit(MAX_PAGES)).alias("last"))


def origin_first(name: Column) -> Column:
    """``struct(name, region)``: up to four words before a dash are an origin if three or more follow."""
    pattern = r"^([^\d–—]{3,42})\s+[–—]\s+(.{12,})$"
    region, rest = F.trim(F.regexp_extract(name, pattern, 1)), F.trim(F.regexp_extract(name, pattern, 2))
    ok = name.rlike(pattern) & (F.size(F.split(region, r"\s+")) <= 4) & (F.size(F.split(rest, r"\s+")) >= 3)
    return F.struct(F.when(ok, rest).otherwise(name).alias("name"), F.when(ok, region).otherwise("").alias("region"))


def boxed_shop(pages: DataFrame) -> DataFrame:
    """Boxes of a common shop system: only with a struck price, the amount is the least below it; an origin may lead the name."""
    t = H.tiles(pages, ".product-box", {"shown": ".product-name", "producer": ".product-description", "price": ".product-price", "listed": ".list-price-price|.list-price", "href": "a.product-name@href|a@href", "unit": ".price-unit-content"}, keep=["url"])
    t = _absolute(t.where("shown <> ''").withColumn("_o", origin_first(F.col("shown"))).withColumn("_page", F.col("url")), base="_page")
    maker = F.when(F.coalesce("producer", F.lit("")).contains(".") | (F.size(F.split(F.coalesce("producer", F.lit("")), r"\s+")) > 6), "").otherwise(F.coalesce("producer", F.lit("")))
    t = t.withColumns({"name": _with_producer(F.trim(F.regexp_replace("_o.name", r"(?i)/(?:bc|b|c)\s*$", "")), maker), "_price": F.coalesce(F.nullif("price", F.lit("")), F.col("all_text"))})
    t = t.withColumn("reference", F.coalesce(_struck(F.col("_price")), F.get(_chf(F.col("listed")), F.lit(0)))).withColumn("amount", A.below_reference(_chf(F.col("_price")), F.col("reference"))).where("amount IS NOT NULL")
    return t.select("name", "amount", "reference", F.when(F.coalesce("unit", F.lit("")) != "", _joined(F.col("unit"), F.col("name"))).otherwise(_joined(F.col("name"), F.col("all_text"))).alias("basis_text"), "url",
                    _year(F.concat_ws(" ", "name", "url"), True).alias("vintage"), F.col("_o.region").alias("region"), F.lit(True).alias("vat"), "position")


def instead_shop(pages: DataFrame) -> DataFrame:
    """Boxes that say ``statt`` between two amounts."""
    t = H.tiles(pages, ".product", {"shown": "a.product__title", "href": "a.product__title@href", "producer": ".product__producer", "price": ".product__price", "size": ".product__bottle-size", "year": ".product__vintage"}, keep=["url"])
    t = _absolute(t.where("shown <> ''").withColumn("_page", F.col("url")), base="_page").withColumns({"name": _with_producer(F.col("shown"), F.coalesce("producer", F.lit(""))), "_a": _chf(F.col("price"))})
    t = t.where(F.lower("price").contains("statt") & (F.size("_a") >= 2)).withColumns({"amount": F.array_min("_a"), "reference": F.array_max("_a")}).where("amount < reference")
    return t.select("name", "amount", "reference", _joined(F.col("size"), F.col("name")).alias("basis_text"), "url", F.when(F.col("year").rlike(r"^\d+$"), F.col("year").try_cast("int")).alias("vintage"), F.lit(True).alias("vat"), "position")


def village_shop(pages: DataFrame) -> DataFrame:
    """Boxes whose title holds a second line with the year, and whose size stands in parentheses."""
    t = H.tiles(pages, ".c-product", {"shown": "h3.c-product__title", "extra": "h3.c-product__title p", "price": "span.c-product__price-main", "block": "div.c-product__price", "about": "div.c-product__description", "href": "a@href"}, keep=["url"])
    bare = F.when((F.coalesce("extra", F.lit("")) != "") & F.col("shown").endswith(F.col("extra")), F.trim(F.expr("substring(shown, 1, length(shown) - length(extra))"))).otherwise(F.col("shown"))
    t = _absolute(t.withColumns({"name": bare, "amount": X.parse_price(F.col("price")), "reference": _struck(F.col("block")), "_page": F.col("url")}).where("name <> '' AND amount IS NOT NULL AND reference > amount"), base="_page")
    return t.select("name", "amount", "reference", F.coalesce(F.lower(A.size_in_parentheses(F.col("about"))), F.lit("")).alias("basis_text"), "url", _year(F.col("extra")).alias("vintage"), "position")


def outlet(pages: DataFrame) -> DataFrame:
    """Boxes with a price per litre: a size that fits neither the amount nor the struck price is not believed."""
    t = H.tiles(pages, ".product-item", {"shown": ".product-name", "maker": "a.product-desc-section", "price": ".product-price", "instead": ".product-instead-price", "litre": ".product-liter-price", "year": ".product-year", "href": "a@href"}, keep=["url"])
    head = F.split(F.substring_index("maker", " - ", 1), r"\s+")
    producer = F.when(F.col("maker").contains(" - ") & (F.size(head) > 1), F.array_join(F.slice(head, F.lit(1), F.size(head) - 1), " ")).otherwise("")
    t = t.where("shown <> ''").withColumns({"name": _with_producer(F.col("shown"), producer), "amount": F.get(_chf(F.col("price")), F.lit(0)), "reference": F.get(_chf(F.col("instead")), F.lit(0)), "_page": F.col("url")}).where("amount < reference")
    size = r"(?i)/\s*(\d+(?:[.,]\d+)?)\s*(cl|dl|l|ml)\b"
    ml = P.to_ml(P.number(F.nullif(F.regexp_extract("price", size, 1), F.lit(""))), F.regexp_extract("price", size, 2))
    stated = X.parse_price(F.nullif(F.regexp_extract("litre", r"(?i)\(\s*(?:CHF|Fr\.?)\s*([\d'’.,]+)\s*/\s*L", 1), F.lit("")))
    fits = ml.isNull() | A.unit_price_agrees(F.col("amount"), ml, stated, F.col("reference"))
    return _absolute(t, base="_page").select("name", "amount", "reference", _joined(F.when(fits, F.col("price")).otherwise(""), F.col("name")).alias("basis_text"), "url", F.when(F.col("year").rlike(r"^\d+$"), F.col("year").try_cast("int")).alias("vintage"), F.lit(True).alias("vat"), "position")


_HIT = ("array<struct<vintage:struct<year:string,wine:struct<id:bigint,name:string,type_id:int,winery:struct<name:string>>,statistics:struct<ratings_average:double,ratings_count:bigint>>,"
        "price:struct<id:bigint,amount:double,discounted_from:double,bottle_type:struct<id:int>,bottle_quantity:int,sku:string,url:string>>>")


def market_hits(payloads: DataFrame, corrections: DataFrame | None = None, page: str = "https://ratings.example/w/") -> DataFrame:
    """Marketplace hits that are real markdowns of standard bottles, one per price, with the ratings they bring along.

    ``corrections(url, name)`` names what the marketplace mislabels; such a hit keeps its offer and loses the rating.
    """
    m = payloads.select(F.explode(F.from_json("payload", _HIT)).alias("m")).select("m.vintage", "m.price")
    wine, p = F.col("vintage.wine"), F.col("price")
    house = _words(wine["winery"]["name"])
    own = _words(wine["name"])
    rows = m.where((p["amount"] > 0) & (p["discounted_from"] > p["amount"]) & (p["bottle_type"]["id"] == STANDARD_BOTTLE)).dropDuplicates(["price"]).withColumns({
        "name": F.when((house == "") | F.lower(own).contains(F.lower(house)), own).otherwise(_joined(house, own)), "vintage_year": F.when(F.col("vintage.year").rlike(r"^\d+$"), F.col("vintage.year").try_cast("int")),
        "entity_url": F.when(wine["id"].isNotNull(), F.concat(F.lit(page), wine["id"]))})
    link = F.coalesce(F.nullif(F.regexp_replace(F.coalesce(p["url"], F.lit("")), "^http://", "https://"), F.lit("")), F.concat("entity_url", F.coalesce(F.concat(F.lit("?year="), "vintage_year"), F.lit(""))))
    rows = rows.where("name <> ''").select("name", p["amount"].alias("amount"), p["discounted_from"].alias("reference"), F.lit("75 cl").alias("basis_text"), link.alias("url"), p["sku"].alias("article"), F.col("vintage_year").alias("vintage"),
                                           F.lit(True).alias("vat"), F.when(p["bottle_quantity"] > 1, p["bottle_quantity"]).alias("pack"), F.col("vintage.statistics.ratings_average").alias("rating"), F.col("vintage.statistics.ratings_count").alias("rating_count"),
                                           "entity_url", wine["type_id"].alias("type_id"), p["id"].alias("price_id")).dropDuplicates(["price_id"])
    if corrections is None:
        return rows
    fixed = corrections.select("url", F.col("name").alias("_right")).dropDuplicates(["url"])
    rows = A.attach(rows, fixed, ["url"])
    wrong = F.col("_right").isNotNull()
    return rows.withColumns({"name": F.coalesce("_right", "name"), "rating": F.when(~wrong, F.col("rating")), "rating_count": F.when(~wrong, F.col("rating_count"))}).drop("_right")


def cash_and_carry(catalog: DataFrame, leaflet: DataFrame, web: DataFrame | None = None) -> DataFrame:
    """The catalog's records, the leaflet's only if it has none, and the web catalog's beside them where there was a login; prices without tax."""
    out = A.first_answer([catalog, leaflet])
    out = out if web is None else out.unionByName(web, allowMissingColumns=True)
    return out.withColumn("vat", F.lit(False))


#: Readers by the kind of source, and how their amounts are meant.
READERS: dict[str, tuple[Callable[..., DataFrame], Shop]] = {
    "aggregator": (aggregator, Shop("aggregator")), "wholesaler": (wholesaler, Shop("wholesaler", price_basis="bottle")), "discounter": (discounter, Shop("discounter")), "api_shop": (api_shop, Shop("api_shop", price_basis="bottle")),
    "nested_shop": (nested_shop, Shop("nested_shop", price_basis="bottle")), "cellar": (cellar, Shop("cellar")), "boxed_shop": (boxed_shop, Shop("boxed_shop", price_basis="bottle")), "instead_shop": (instead_shop, Shop("instead_shop", price_basis="bottle")),
    "village_shop": (village_shop, Shop("village_shop", price_basis="bottle")), "outlet": (outlet, Shop("outlet", price_basis="bottle")), "market_hits": (market_hits, Shop("market_hits", price_basis="bottle")),
}


def offers(kind: str, landed: DataFrame, source: str | None = None, **options: object) -> DataFrame:
    """Offers of a source's landed pages or payloads; tiles sold by bottle or carton are read by their own basis."""
    if kind == "tile_shop":
        raw = tile_shop(landed, **options)  # type: ignore[arg-type]
        parts = [A.make_offers(raw.where(F.col("basis") == basis).drop("basis"), Shop(source or kind, price_basis=basis)) for basis in ("bottle", "pack")]
        return A.dedupe_offers(parts[0].unionByName(parts[1]))
    reader, shop = READERS[kind]
    return A.make_offers(reader(landed, **options), replace(shop, key=source or shop.key))


def fetch(landed: DataFrame, kinds: dict[str, str], **options: dict) -> tuple[DataFrame, DataFrame]:
    """``(offers, report)`` of ``landed(source, url, html, status_code)``: one reader per source in ``kinds``.

    Pages that show a protection instead of their content are left out; a source's
    offers count although a later page of it was blocked.
    """
    seen = landed.withColumn("block", H.detect_block(F.col("html")))
    good = seen.where("block IS NULL AND coalesce(status_code, 200) < 400").withColumn("payload", F.col("html"))
    found = None
    for source, kind in kinds.items():
        got = offers(kind, good.where(F.col("source") == source).drop("source", "status_code", "block"), source, **options.get(source, {}))
        found = got if found is None else found.unionByName(got)
    if found is None:
        raise ValueError("no source is named")
    from .registry import fetch_report

    return found, fetch_report(found, seen.withColumn("status_code", F.coalesce("status_code", F.lit(200))))
