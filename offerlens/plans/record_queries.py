"""Registered queries of the record readers: pages and payloads are written from the tables' rows and read back as offers.

Names are words made from an item's number, so every row has its own, and no word
list holds them. The SQL says from the same rows what a reader must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators import maturity
from ..sources import adapters, leaflet, pages, ratings, registry, shops
from .queries import query
from .tables import table


def _word(i: int) -> str:
    """Eight letters of an item's number ``k``, the same in both engines."""
    return f"substr(translate(md5(concat(k, '-', {i})), '0123456789', 'ghijklmnop'), 1, 8)"


BASE_SQL = "w AS (SELECT k, z, " + ", ".join(f"{_word(i)} AS {c}" for i, c in enumerate("abcd")) + " FROM (SELECT p_partkey AS k, p_size AS z FROM part))"


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, z`` and four words of every item."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    return p.select("k", "z", *(F.expr(_word(i)).alias(c) for i, c in enumerate("abcd")))


def _land(rows: DataFrame, html: Column, column: str = "html") -> DataFrame:
    return rows.select(F.concat(F.lit("https://shop.example/list/"), F.col("k")).alias("url"), html.alias(column))


def _text(*parts: str | Column) -> Column:
    """Strings as they are, columns by their value."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))


def cols(names: str) -> list[Column]:
    return [F.col(c) for c in names]


def _amount(c: Column) -> Column:
    return F.concat(c, F.lit(".50"))


@query(f"""WITH {BASE_SQL} SELECT upper(left(a, 1)) || substr(a, 2) || ' ' || b AS name, z + 4.5::DOUBLE AS amount, CASE WHEN z % 2 = 0 THEN z + 14.5::DOUBLE END AS reference,
  CASE z % 3 WHEN 0 THEN 'ottos' WHEN 1 THEN 'coop' ELSE 'laden' || a END AS seller, CAST(k AS VARCHAR) AS article, 'https://shop.example/d/' || k AS url FROM w WHERE z % 5 <> 0""")
def aggregator_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, Z, A, B = cols("kzab")
    label = F.when(Z % 3 == 0, F.lit("Otto's")).when(Z % 3 == 1, F.lit("COOP Megastore")).otherwise(F.concat(F.lit("Läden "), A))
    html = _text('<div class="card dealtype-deal" data-upox-id="', K, '"><div class="card-image"><img alt="', F.initcap(A), " ", B, '"></div><div class="card-merchant"><img alt="', F.replace(label, F.lit("Läden "), F.lit("Laden ")),
                 '"></div><span class="price-new">', _amount(Z + 4), "</span>", F.when(Z % 2 == 0, _text('<span class="price-old">CHF ', _amount(Z + 14), "</span>")).otherwise(""),
                 '<a href="/d/', K, '">x</a><span class="card-date">bis ', F.when(Z % 5 == 0, "1.2.2020").otherwise("1.2.2030"), "</span>")
    got = shops.aggregator(_land(base(spark, sf_dir), html), F.lit("2025-01-01").cast("date"))
    return got.select("name", "amount", "reference", "seller", "article", "url")


@query(f"""WITH {BASE_SQL} SELECT upper(left(a, 1)) || substr(a, 2) || ' ' || b || ', 75 cl' AS name, CASE WHEN z % 4 = 0 THEN z * 6.0::DOUBLE ELSE z::DOUBLE END AS amount, CASE WHEN z % 4 <> 0 THEN 6::DOUBLE END AS pack,
  z % 4 <> 0 AS sure, CAST(k AS VARCHAR) AS article, 'Vins rouges' AS category FROM w""")
def wholesale_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, Z, A, B = cols("kzab")
    unit = F.when(Z % 4 != 0, F.struct(F.lit("Z06").alias("code"), F.lit(6).alias("number")))
    price = F.struct((Z * 6.0).alias("discountPriceTTC"), (Z * 9.0).alias("salesPriceTTC"))
    said = F.struct(F.struct(F.initcap(A).alias("advertisingText"), B.alias("additionalDesignation")).alias("fr"))
    group = F.struct(F.struct(F.struct(F.lit("Vins rouges").alias("wording")).alias("fr")).alias("translations"))
    item = F.struct(K.cast("string").alias("sKU"), F.lit("75 cl").alias("packagingLabel"), unit.alias("quantityUnit"), said.alias("translations"), price.alias("mainArticleDetailPrice"),
                    F.struct(K.cast("string").alias("articleNumber"), group.alias("articleGroup")).alias("article"))
    escaped = F.replace(_json(items=F.array(item, item)), F.lit('"'), F.lit("&quot;"))
    got = shops.wholesaler(_land(base(spark, sf_dir), _text('<x pagination="', escaped, '">')))
    return got.select("name", "amount", F.col("pack").cast("double").alias("pack"), "sure", "article", "category")


@query(f"""WITH {BASE_SQL} SELECT a || ' ' || b AS name, z + 4.5::DOUBLE AS amount, CASE WHEN z % 3 = 0 THEN '6 × 75 cl' ELSE '75 cl' END AS basis_text, CAST(k AS VARCHAR) AS article FROM w WHERE z % 7 <> 0""")
def discounter_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, Z, A, B = cols("kzab")
    attribute = lambda place, name, value: f'{{"attributeName":"{name}","vals":{place + 1}}},[{place + 2}],{{"value":{place + 3},"label":{place + 3}}},{value}'
    parts = [("name", _text('"', A, " ", B, '"')), ("category", F.when(Z % 7 == 0, F.lit('"Bier"')).otherwise('"Rotwein Weine"')), ("priceFormatted", _text('"', _amount(Z + 4), '"')),
             ("box_item_count", F.when(Z % 3 == 0, F.lit('"6"')).otherwise('"1"')), ("content_size_text", F.lit('"75 cl"')), ("pimcoreId", _text('"', K, '"'))]
    first = 3  # places of the attributes behind the object, its number and their list
    head = f'[{{"sku":1,"attributeInfo":2}},"S1",[{",".join(str(first + 4 * i) for i in range(len(parts)))}]'
    cells = [piece for i, (name, value) in enumerate(parts) for piece in (f',{{"attributeName":"{name}","vals":{first + 4 * i + 1}}},[{first + 4 * i + 2}],{{"value":{first + 4 * i + 3},"label":{first + 4 * i + 3}}},', value)]
    html = _text('<script id="__NUXT_DATA__">', head, *cells, "]</script>")
    return shops.discounter(_land(base(spark, sf_dir), F.replace(html, F.lit('"S1"'), _text('"S', K, '"')))).select("name", "amount", "basis_text", "article")


@query(f"""WITH {BASE_SQL} SELECT k, a AS name, b AS house, z AS total, c AS label FROM w""")
def turbo_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat array whose keys and values are places: scalars at a place are values, and an object's own place in itself is cut."""
    Z, A, B, C = cols("zabc")
    text = _text('[{"_1":2,"_3":4,"_5":6,"_9":0},"name","', A, '","total",', Z, ',"winery",{"_7":8},"house","', B, '","self"]')
    other = _text('[{"label":1,"me":0},["Ref",2],"', C, '"]')
    rows = base(spark, sf_dir).select("k", pages.graph_objects(text, ["name", "total"], True)[0].alias("o"), pages.graph_objects(other, ["label"])[0].alias("p"))
    j = lambda c, path: F.get_json_object(c, path)
    return rows.where(j("o", "$.self.total").isNotNull() & j("o", "$.self.self").isNull()).select("k", j("o", "$.name").alias("name"), j("o", "$.winery.house").alias("house"), j("o", "$.total").cast("int").alias("total"), j("p", "$.label").alias("label"))


@query(f"""WITH {BASE_SQL} SELECT a || ' ' || b AS name, (z + 4)::DOUBLE AS amount, (z + 10)::DOUBLE AS reference, CASE WHEN z % 4 = 0 THEN '' ELSE '750 ml' END AS basis_text, 'https://shop.example/de/' || a AS url FROM w WHERE z % 5 <> 0 AND z % 6 <> 0""")
def api_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, Z, A, B = cols("kzab")
    amount = lambda x: F.struct(x.alias("amount"))
    litre = F.when(Z % 4 == 0, F.lit(1.0)).otherwise(F.round((Z + 4) / 0.75, 2))
    price = F.struct(amount((Z + 4) * 100).alias("discountPrice"), amount(F.when(Z % 6 == 0, (Z + 1) * 100).otherwise((Z + 10) * 100)).alias("initialPrice"), amount(litre).alias("literPrice"))
    variant = F.struct(K.cast("string").alias("sku"), (Z % 5 != 0).alias("published"), F.lit(True).alias("active"), price.alias("price"), F.struct(F.create_map(F.lit("de"), B).alias("producer"), F.lit(7500).alias("bottleSize")).alias("attributes"))
    product = F.struct(F.create_map(F.lit("de-CH"), A).alias("name"), F.create_map(F.lit("de-CH"), A).alias("slug"), variant.alias("masterVariant"))
    return shops.api_shop(_land(base(spark, sf_dir), F.to_json(F.array(product)), "payload")).select("name", "amount", "reference", "basis_text", "url")


def _tile(rows: DataFrame) -> DataFrame:
    K, Z, A, B = cols("kzab")
    by = lambda unit, main: F.create_map(F.lit("B"), unit, F.lit("K"), main)
    money = lambda c: c.cast("decimal(12,2)").cast("string")
    detail = lambda n: F.struct(F.lit(n).alias("quantity"), F.lit(True).alias("isSellable"))
    product = _json(
        id=_text("A ", K, " 2019"), name=F.initcap(A), description=B, isSellable=(Z % 7 != 0), isSellableByUnit=(Z % 3 != 0), conditioningDetail=F.struct(F.lit(75.0).alias("capacity")), packaging=F.struct(F.lit("B").alias("unit"), F.lit("K").alias("main")),
        packagingDetails=by(detail(1), detail(6)), price=by(money(Z * 3), money(Z * 18)), insteadOfPrice=by(money(Z * 5), money(Z * 30)),
        promotion=F.when(Z % 4 != 0, F.struct(F.lit("25").alias("percent"), by(money(Z * 4), money(Z * 24)).alias("regularPrice"))), gAData=F.struct(F.array(F.struct(F.when(Z % 5 == 0, "Spirituosen").otherwise("Flaschenweine").alias("item_category"))).alias("items")))
    return _land(rows, _text('<div x-data="product(', F.replace(product, F.lit('"'), F.lit("&quot;")), ')"></div>', F.when(Z % 2 == 0, F.lit('<div x-data="product({&quot;id)"></div><div x-data="product({&quot;id&quot;:})"></div>')).otherwise("")))


@query(f"""WITH {BASE_SQL} SELECT upper(left(a, 1)) || substr(a, 2) || ' ' || b AS name, (CASE WHEN z % 3 = 0 THEN z * 18 ELSE z * 3 END)::DOUBLE AS amount, (CASE WHEN z % 4 = 0 THEN NULL WHEN z % 3 = 0 THEN z * 24 ELSE z * 4 END)::DOUBLE AS reference,
  CASE WHEN z % 3 = 0 THEN 'Karton 6 x 75 cl' ELSE '1 x 75 cl' END AS basis_text, 2019 AS vintage FROM w WHERE z % 7 <> 0 AND z % 5 <> 0""")
def tile_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shops.tile_shop(_tile(base(spark, sf_dir))).select("name", "amount", "reference", "basis_text", "vintage")


@query(f"WITH {BASE_SQL} SELECT 'https://shop.example/list/' || k AS url, CASE WHEN z % 2 = 0 THEN 3 ELSE 1 END AS expected, CASE WHEN z % 2 = 0 THEN 2 ELSE 1 END AS read, CASE WHEN z % 2 = 0 THEN 1 ELSE 0 END AS broken, CASE WHEN z % 2 = 0 THEN 1 ELSE 0 END AS missed FROM w")
def tile_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shops.tile_balance(_tile(base(spark, sf_dir)))


@query(f"""WITH {BASE_SQL} SELECT c || ' ' || a AS name, (z + 5)::DOUBLE AS amount, (z + 9)::DOUBLE AS reference, '75 cl ' || c || ' ' || a AS basis_text, CASE WHEN z % 3 = 0 THEN (2015 + z % 8)::DOUBLE END AS vintage, 'https://shop.example/' || a || '/p' AS url FROM w WHERE z % 4 <> 0""")
def nested_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B, C = cols("zabc")
    p = F.struct(F.when(Z % 4 == 0, Z).otherwise(Z + 9).alias("oldPrice"), (Z + 5).alias("price"), F.lit(1).alias("packaging"), A.alias("title1"), B.alias("title2"), C.alias("title3"), A.alias("slug"), F.struct(F.lit("75 cl").alias("name")).alias("size"),
                 F.when(Z % 3 == 0, F.struct((2015 + Z % 8).cast("string").alias("name"))).alias("year"))
    payload = _text("var x = ", F.to_json(F.struct(F.array(F.struct(p.alias("inner"))).alias("deep"))), "; // {")
    return shops.nested_shop(_land(base(spark, sf_dir), payload, "payload")).select("name", "amount", "reference", "basis_text", F.col("vintage").cast("double").alias("vintage"), "url")


@query("SELECT 'https://shop.example/list/' || p_partkey AS url, CASE WHEN p_size % 3 = 0 THEN 0 ELSE p_size + 2 END AS total FROM part")
def claimed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, = cols("z")
    payload = F.when(Z % 3 == 0, F.lit('{"count":9,"data":1}')).otherwise(_text('{"a":{"count":', Z, ',"data":[]},"b":[{"count":', Z + 2, ',"data":[{"x":1}]}]}'))
    return shops.claimed_total(_land(base(spark, sf_dir), payload, "payload"))


@query(f"""WITH {BASE_SQL} SELECT upper(left(a, 1)) || substr(a, 2) || ' (' || upper(left(b, 1)) || substr(b, 2) || ')' AS name, z + 9.5::DOUBLE AS amount, CASE WHEN z % 2 = 0 THEN z + 19.5::DOUBLE END AS reference,
  c || ' 2018' || CASE WHEN z % 3 = 0 THEN ' Karton 6 x 75 cl' ELSE '' END AS basis_text, 2018 AS vintage, '95 ' || d AS critic_text FROM w""")
def cellar_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B, C, D = cols("zabcd")
    html = _text('<ol><li class="product-item"><a class="product-item-link" href="/', B, "-", A, F.when(Z % 3 == 0, "-3x2019-3x2020").otherwise(""), '.html">', F.initcap(A), '</a><div class="price-box"><span class="special-price">CHF ', _amount(Z + 9), "</span>",
                 F.when(Z % 2 == 0, _text('<span class="old-price">CHF ', _amount(Z + 19), "</span>")).otherwise(_text('<span class="old-price">CHF ', Z, "</span>")),
                 '</div><span class="cs-product-tile__attribute">', C, '</span><span class="cs-product-tile__attribute">2018</span><i class="cs-product-tile__attributes-item-value">95 ', D, "</i><li class=other>x</ol>")
    return shops.cellar(_land(base(spark, sf_dir), html)).select("name", "amount", "reference", "basis_text", "vintage", "critic_text")


@query("SELECT 'https://shop.example/list/' || p_partkey AS url, CASE WHEN p_size % 4 = 0 THEN 40 ELSE least(p_size, 40) END AS last FROM part")
def last_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, = cols("z")
    html = F.when(Z % 4 == 0, F.lit("<p>no pager</p>")).otherwise(_text('<form><input data-role="x" max="99"><input data-role="pager" max="', Z, '"></form>'))
    return shops.last_page(_land(base(spark, sf_dir), html))


@query(f"""WITH {BASE_SQL} SELECT a || ' ' || b || ' ' || c || CASE WHEN z % 3 = 0 THEN '' ELSE ' ' || d END AS name, z + 4.5::DOUBLE AS amount, z + 9.5::DOUBLE AS reference, CASE WHEN z % 2 = 0 THEN 'Region' ELSE '' END AS region, 'https://shop.example/p/' || k AS url FROM w WHERE z % 5 <> 0""")
def boxed_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, Z, A, B, C, D = cols("kzabcd")
    price = F.when(Z % 5 == 0, _text("CHF ", _amount(Z + 4))).when(Z % 2 == 0, _text("CHF ", _amount(Z + 4), " statt CHF ", _amount(Z + 9))).otherwise(_text(_amount(Z + 4), " CHF"))
    html = _text('<div class="box product-box"><a class="product-name" href="/p/', K, '">', F.when(Z % 2 == 0, "Region – ").otherwise(""), A, " ", B, " ", C, '</a><span class="product-description">', F.when(Z % 3 == 0, _text("A long text. ", D)).otherwise(D), '</span><span class="product-price">', price, "</span>",
                 F.when((Z % 2 != 0) & (Z % 5 != 0), _text('<span class="list-price-price">CHF ', _amount(Z + 9), "</span>")).otherwise(""), "</div>")
    return shops.boxed_shop(_land(base(spark, sf_dir), html)).select("name", "amount", "reference", "region", "url")


@query(f"""WITH {BASE_SQL} SELECT a || ' ' || b AS name, z + 4.5::DOUBLE AS amount, z + 9.5::DOUBLE AS reference, '75 cl ' || a || ' ' || b AS basis_text, CASE WHEN z % 2 = 0 THEN 2020::DOUBLE END AS vintage FROM w WHERE z % 3 <> 0""")
def instead_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B = cols("zab")
    html = _text('<div class="product"><a class="product__title" href="/p">', A, '</a><i class="product__producer">', B, '</i><b class="product__price">CHF ', _amount(Z + 4), F.when(Z % 3 == 0, " nur heute CHF ").otherwise(" statt CHF "), _amount(Z + 9),
                 '</b><i class="product__bottle-size">75 cl</i><i class="product__vintage">', F.when(Z % 2 == 0, "2020").otherwise("N.V."), "</i></div>")
    return shops.instead_shop(_land(base(spark, sf_dir), html)).select("name", "amount", "reference", "basis_text", F.col("vintage").cast("double").alias("vintage"))


@query(f"""WITH {BASE_SQL} SELECT a AS name, z + 4.5::DOUBLE AS amount, z + 9.5::DOUBLE AS reference, CASE WHEN z % 2 = 0 THEN '70 cl' ELSE '' END AS basis_text, 2000 + z % 20 AS vintage FROM w WHERE z % 3 <> 0""")
def village_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, Z, A, B, C = cols("kzabc")
    html = _text('<div class="c-product"><a href="/p/', K, '"><h3 class="c-product__title">', A, " <p>", B, " ", 2000 + Z % 20, '</p></h3></a><div class="c-product__price">', F.when(Z % 3 == 0, "").otherwise(_text("statt CHF ", _amount(Z + 9))),
                 ' <span class="c-product__price-main">', _amount(Z + 4), '</span></div><div class="c-product__description">', C, F.when(Z % 2 == 0, " (70 CL)").otherwise(""), "</div></div>")
    return shops.village_shop(_land(base(spark, sf_dir), html)).select("name", "amount", "reference", "basis_text", "vintage")


@query(f"""WITH {BASE_SQL} SELECT a || ' ' || b AS name, (z * 3)::DOUBLE AS amount, (z * 4)::DOUBLE AS reference, CASE WHEN z % 3 = 0 THEN a || ' ' || b ELSE 'CHF ' || z * 3 || '.00 / 75 cl ' || a || ' ' || b END AS basis_text FROM w""")
def outlet_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B, C = cols("zabc")
    litre = F.when(Z % 3 == 0, Z * 40).when(Z % 3 == 1, Z * 4).otherwise(F.round(Z * 4 / 0.75, 2))
    html = _text('<div class="product-item"><a href="/p"><b class="product-name">', A, '</b></a><a class="product-desc-section">', B, " ", C, ' - rot</a><i class="product-price">CHF ', Z * 3, '.00 / 75 cl</i><i class="product-instead-price">CHF ', Z * 4,
                 '.00</i><i class="product-liter-price">(CHF ', litre.cast("decimal(12,2)"), " / L)</i></div>")
    return shops.outlet(_land(base(spark, sf_dir), html)).select("name", "amount", "reference", "basis_text")


def _hits(rows: DataFrame) -> DataFrame:
    K, Z, A, B = cols("kzab")
    wine = F.struct(K.alias("id"), _text(A, F.when(Z % 2 == 0, _text(" ", B)).otherwise("")).alias("name"), F.lit(1).alias("type_id"), F.struct(B.alias("name")).alias("winery"))
    price = F.struct(K.alias("id"), (Z + 5).alias("amount"), F.when(Z % 6 == 0, Z).otherwise(Z + 9).alias("discounted_from"), F.struct(F.when(Z % 5 == 0, 4).otherwise(1).alias("id")).alias("bottle_type"), F.when(Z % 3 == 0, 6).otherwise(1).alias("bottle_quantity"),
                     F.when(Z % 4 != 0, _text("http://m.example/", K)).alias("url"))
    hit = F.struct(F.struct((2000 + Z % 20).cast("string").alias("year"), wine.alias("wine"), F.struct((3 + (Z % 20) / 10).alias("ratings_average"), (Z * 10).alias("ratings_count")).alias("statistics")).alias("vintage"), price.alias("price"))
    return _land(rows, F.to_json(F.array(hit, hit)), "payload")


@query(f"""WITH {BASE_SQL} SELECT CASE WHEN k % 10 = 3 AND z % 4 <> 0 THEN 'corrected ' || k WHEN z % 2 = 0 THEN a || ' ' || b ELSE b || ' ' || a END AS name, (z + 5)::DOUBLE AS amount, (z + 9)::DOUBLE AS reference,
  CASE WHEN z % 4 <> 0 THEN 'https://m.example/' || k ELSE 'https://ratings.example/w/' || k || '?year=' || (2000 + z % 20) END AS url, CASE WHEN z % 3 = 0 THEN 6::DOUBLE END AS pack, CASE WHEN k % 10 = 3 AND z % 4 <> 0 THEN NULL ELSE round(3 + (z % 20) / 10.0::DOUBLE, 4) END AS rating
FROM w WHERE z % 6 <> 0 AND z % 5 <> 0""")
def marketplace_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, = cols("k")
    rows = base(spark, sf_dir)
    fixed = rows.where("k % 10 = 3").select(_text("https://m.example/", K).alias("url"), _text("corrected ", K).alias("name"))
    return shops.market_hits(_hits(rows), fixed).select("name", "amount", "reference", "url", F.col("pack").cast("double").alias("pack"), F.round("rating", 4).alias("rating"))


@query(f"""WITH {BASE_SQL} SELECT CASE WHEN z % 2 = 0 THEN a || ' ' || b ELSE b || ' ' || a END AS normalized_name, 2000 + z % 20 AS vintage, round(3 + (z % 20) / 10.0::DOUBLE, 4) AS rating, 'exact' AS status, false AS window_checked FROM w WHERE z % 6 <> 0 AND z % 5 <> 0""")
def seeded_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = shops.market_hits(_hits(base(spark, sf_dir))).withColumn("normalized_name", X.normalized_name(F.col("name")))
    return adapters.seed_ratings(hits).select("normalized_name", "vintage", F.round("rating", 4).alias("rating"), "status", "window_checked")


@query(f"WITH {BASE_SQL} SELECT name, price FROM (SELECT a AS name, round((z + 4) * 1.081::DOUBLE + 1e-9, 2) AS price FROM w WHERE z % 2 = 0 UNION ALL SELECT b, round((z + 7) * 1.081::DOUBLE + 1e-9, 2) FROM w WHERE z % 3 = 0)")
def cash_and_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog answers, so the leaflet stays out; the web catalog comes on top; tax is added to all."""
    K, Z, A, B, C = cols("kzabc")
    rows = base(spark, sf_dir)
    # a word of eight letters is met twice among many items: their number as vintage tells them apart
    read = lambda df, name, plus: df.select(name.alias("name"), (Z + plus).cast("double").alias("amount"), K.cast("int").alias("vintage"))
    raw = shops.cash_and_carry(read(rows.where("z % 2 = 0"), A, 4), read(rows, C, 1), read(rows.where("z % 3 = 0"), B, 7))
    return adapters.make_offers(raw, adapters.Shop("market", price_basis="bottle", vat_included=False)).select("name", "price")


@query(f"""WITH {BASE_SQL} SELECT a || ' ' || b || ' 75 cl' AS name, round(z + 4.5::DOUBLE + 1e-9, 2) AS price, 'high' AS confidence, CASE WHEN z % 2 = 0 THEN round((z + 10)::DOUBLE + 1e-9, 2) END AS reference_price,
  CASE WHEN z % 2 = 0 THEN round((1 - (z + 4.5::DOUBLE) / (z + 10)) * 100, 1) END AS discount_percent, CASE WHEN z % 2 <> 0 THEN 'unknown' WHEN contains(a || ' ' || b, 'ab') AND round((1 - (z + 4.5::DOUBLE) / (z + 10)) * 100, 1) > 45 THEN 'questionable' ELSE 'ok' END AS discount_plausibility, contains(a || ' ' || b, 'ab') AS private_label,
  CASE WHEN z % 3 = 0 THEN 2015::DOUBLE END AS vintage, array_to_string(list_sort([a, b]), ' ') || '|' || CASE WHEN z % 3 = 0 THEN '2015' ELSE '' END AS dedup_key FROM w""")
def made_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B = cols("zab")
    raw = base(spark, sf_dir).select(_text(A, " ", B, " 75 cl").alias("name"), (Z + 4.5).alias("amount"), F.when(Z % 2 == 0, (Z + 10).cast("double")).alias("reference"), F.when(Z % 3 == 0, 2015).alias("vintage"))
    return adapters.make_offers(raw, adapters.Shop("own", private_labels=["ab"])).select("name", "price", "confidence", "reference_price", "discount_percent", "discount_plausibility", "private_label", F.col("vintage").cast("double").alias("vintage"), "dedup_key")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN CAST(o_orderdate AS DATE) >= DATE '1998-06-01' WHEN 2 THEN CAST(o_orderdate AS DATE) + 30 >= DATE '1998-06-01' ELSE true END AS live FROM orders""")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda d: F.date_format(d, "d.M.yyyy")
    date = F.to_date("o_orderdate")
    key = F.col("o_orderkey") % 4
    text = F.when(key == 0, F.lit("solange Vorrat")).when(key == 1, _text("gültig bis ", day(date))).when(key == 2, _text(day(date), " - ", day(F.date_add(date, 30)))).otherwise("bis 45.13.2001")
    return table(spark, sf_dir, "orders").select("o_orderkey", adapters.not_expired(text, F.lit("1998-06-01").cast("date")).alias("live"))


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'ottos' WHEN 1 THEN lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) END AS key FROM supplier""")
def merchant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("s_suppkey") % 3 == 0, "OTTO'S").when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).otherwise("***")
    return table(spark, sf_dir, "supplier").select("s_suppkey", adapters.merchant_key(label, shops.MERCHANTS).alias("key"))


@query(f"""WITH {BASE_SQL} SELECT k, CASE WHEN z % 3 = 0 THEN 'https://c.example/rot' ELSE 'https://c.example/s?q=' || a || '%20' || b || '%20' || c || '%3Arelevance%3Asale%3Atrue&sort=x' END AS url FROM w""")
def promo_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B, C, D = cols("zabcd")
    own = {"standard": "https://c.example/s?q=%3Arelevance%3Asale%3Atrue&sort=x"}
    named = adapters.promo_page(_text(A, " ", B, " ", C, " ", D, " – Rotwein, 75 cl"), own)
    colour = adapters.promo_page(F.lit("2019 – Rotwein"), {"rot": "https://c.example/rot", "weiss": "https://c.example/weiss"})
    return base(spark, sf_dir).select("k", F.when(Z % 3 == 0, colour).otherwise(named).alias("url"))


@query("SELECT p_size % 5 AS shop, arg_max('https://l.example/' || (2020 + p_partkey % 6) || '-' || (1 + p_partkey % 12) || '_kw' || (1 + p_partkey % 52) || '.pdf', (2020 + p_partkey % 6) * 10000 + (1 + p_partkey % 12) * 100 + (1 + p_partkey % 52)) AS url FROM part WHERE p_size % 5 = 0 GROUP BY 1")
def newest_leaflet(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, = cols("k")
    rows = base(spark, sf_dir).where("z % 5 = 0").select(_text("https://l.example/", 2020 + K % 6, "-", 1 + K % 12, "_kw", 1 + K % 52, ".pdf").alias("url"))
    return leaflet.newest_leaflet(rows).select(F.lit(0).alias("shop"), "url").where("url IS NOT NULL")


@query(f"""WITH {BASE_SQL} SELECT k AS page, a || ' ' || b || CASE WHEN z % 2 = 0 THEN ' ' || c ELSE '' END AS name, CASE WHEN z % 3 <> 0 THEN z + 4.5::DOUBLE END AS amount, CASE WHEN z % 4 = 0 THEN z + 9.5::DOUBLE END AS reference, CASE WHEN z % 5 = 0 THEN 'kg' ELSE '75 cl' END AS unit,
  CASE WHEN z % 3 = 0 THEN 'no price' WHEN z % 5 = 0 THEN 'not by the bottle' ELSE 'sure' END AS verdict FROM w""")
def leaflet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with places around one article number a page, in lines above and below it; words of another column stay out."""
    K, Z, A, B, C, D = cols("kzabcd")
    rows = base(spark, sf_dir)
    at = lambda text, x, top: F.struct(text.alias("text"), F.lit(float(x)).alias("x0"), F.lit(float(top)).alias("top"))
    lit = F.lit
    words = F.array(at(lit("Aktion"), 10, 300), at(F.when(Z % 5 == 0, "kg").otherwise("75"), 10, 320), at(F.when(Z % 5 != 0, "cl"), 30, 321), at(F.when(Z % 4 == 0, "statt"), 10, 340), at(F.when(Z % 4 == 0, _amount(Z + 9)), 40, 340), at(F.when(Z % 3 != 0, _amount(Z + 4)), 12, 360),
                    at(A, 10, 420), at(B, 60, 421), at(F.when(Z % 2 == 0, C), 10, 440), at(lit("2019"), 10, 455), at(lit("Schweiz"), 10, 470), at(D, 400, 430), at(lit("weit"), 10, 900))
    pages_ = rows.select(K.alias("page"), F.explode(words).alias("w")).select("page", "w.*").where("text IS NOT NULL")
    anchors = rows.select(K.alias("page"), F.explode(F.array(F.struct(lit("left").alias("anchor"), lit(10.0).alias("x0")), F.struct(lit("right").alias("anchor"), lit(400.0).alias("x0")))).alias("a")).select("page", "a.*", lit(400.0).alias("top"))
    fields = leaflet.cell_fields(leaflet.cells(pages_, anchors).where("anchor = 'left'"), ["schweiz"])
    sure, unsure = leaflet.leaflet_records(fields)
    return unsure.select("page", "name", "amount", "reference", "unit", F.col("doubt").alias("verdict")).unionByName(sure.select("page", "name", "amount", "reference", F.col("basis_text").alias("unit"), F.lit("sure").alias("verdict")))


@query("""WITH y AS (SELECT p_partkey AS k, p_size AS z, unnest(range(0, 4)) AS i FROM part) SELECT 'b' || (k % 3) || '-' || k AS block, 2018 + i AS vintage, CASE WHEN (z + i) % 4 = 3 THEN '-' ELSE substr('gk*', 1 + (z + i) % 4, 1) END AS code FROM y WHERE NOT (z % 6 = 0 AND i = 2)
  UNION ALL SELECT 'b' || (k % 3) || '-' || k, 2020, '-' FROM y WHERE z % 6 = 0 AND i = 2""")
def maturity_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coloured glyphs under year columns: the nearest column within the tolerance, the block whose head stands above, blanks as a dash."""
    rows = base(spark, sf_dir).select("k", "z", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    kind = (F.col("z") + F.col("i")) % 4
    colour = lambda part: F.when(kind == 0, F.lit((0.0, 0.6, 0.2)[part])).when(kind == 1, F.lit((0.9, 0.8, 0.0)[part])).otherwise(F.lit((0.8, 0.1, 0.1)[part])) + 0.01
    code = maturity.glyph_code(colour(0), colour(1), colour(2), F.when(kind == 3, "–").otherwise("●"), {"g": (0.0, 0.6, 0.2), "k": (0.9, 0.8, 0.0), "*": (0.8, 0.1, 0.1)})
    off = F.when((F.col("z") % 6 == 0) & (F.col("i") == 2), 15.0).otherwise((F.col("z") % 11 - 5).cast("double"))
    glyphs = rows.select(F.col("k").alias("page"), code.alias("text"), (100.0 + 40 * F.col("i") + off).alias("x"), F.lit(50.0).alias("top"))
    heads = rows.where("i = 0").select(F.col("k").alias("page"), F.explode(F.array(F.struct(F.lit("zz").alias("block"), F.lit(10.0).alias("top")), F.struct(_text("b", F.col("k") % 3, "-", F.col("k")).alias("block"), F.lit(30.0).alias("top")), F.struct(F.lit("below").alias("block"), F.lit(70.0).alias("top")))).alias("h")).select("page", "h.*")
    columns = rows.select(F.col("k").alias("page"), (2018 + F.col("i")).alias("year"), (100.0 + 40 * F.col("i")).alias("x"))
    return maturity.year_table(maturity.blocks(glyphs, heads).withColumnRenamed("text", "code"), columns)


def _payloads(rows: DataFrame) -> DataFrame:
    K, Z, A, B, C, D = cols("kzabcd")
    axes = lambda s: F.struct(F.when(s % 2 == 0, s / 10).otherwise(0.0).alias("sweetness"), (s / 20).alias("tannin"), F.lit(None).cast("double").alias("acidity"), s.cast("long").alias("user_structure_count"))
    wine = F.struct(K.alias("id"), A.alias("name"), (Z % 4).alias("type_id"), A.alias("seo_name"), F.struct(B.alias("name"), B.alias("seo_name")).alias("winery"), F.struct(C.alias("name"), F.struct(D.alias("name")).alias("country")).alias("region"), F.struct(axes(Z).alias("structure")).alias("taste"))
    stats = F.struct((Z % 5).cast("double").alias("ratings_average"), (Z * 2).cast("long").alias("ratings_count"), F.lit(3.9).alias("wine_ratings_average"), (Z * 9).cast("long").alias("wine_ratings_count"))
    price = lambda amount, code, n, ml: F.struct(amount.cast("double").alias("amount"), F.struct(F.lit(code).alias("code")).alias("currency"), F.lit(n).alias("bottle_quantity"), F.struct(F.lit(ml).alias("volume_ml")).alias("bottle_type"), F.lit("https://s.example/").alias("url"))
    prices = F.array(price(Z * 6, "CHF", 6, 750), price(Z, "EUR", 1, 750), price(Z * 2, "chf", 1, 1500), price(Z * 0, "CHF", 1, 750))
    match = F.struct(F.struct(K.alias("id"), _text(B, " ", A).alias("name"), F.when(Z % 3 == 0, "N.V.").otherwise((2000 + Z % 20).cast("string")).alias("year"), wine.alias("wine"), stats.alias("statistics")).alias("vintage"), prices.alias("prices"))
    return rows.select(_json(explore_vintage=F.struct(F.array(match, match).alias("matches"))).alias("payload"))


@query(f"""WITH {BASE_SQL} SELECT k AS wine_id, b || ' ' || a AS name, CASE WHEN z % 3 <> 0 THEN (2000 + z % 20)::DOUBLE END AS year, CASE WHEN z % 5 > 0 THEN (z % 5)::DOUBLE END AS vintage_avg, z * 2 AS vintage_count, CASE WHEN z % 4 > 0 THEN (z % 4)::DOUBLE END AS type_id,
  z * 2 >= 5 AND z % 5 > 0 AS rated, 'https://ratings.example/' || a || '/w/' || k AS url, d AS country FROM w""")
def rating_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ratings.entries(_payloads(base(spark, sf_dir))).select("wine_id", "name", F.col("year").cast("double").alias("year"), "vintage_avg", "vintage_count", F.col("type_id").cast("double").alias("type_id"), "rated", "url", "country")


@query(f"""WITH {BASE_SQL} SELECT k AS wine_id, 2 AS prices, round(z::DOUBLE, 2) AS cheapest, CASE WHEN z % 2 = 0 THEN round(z / 10.0::DOUBLE, 4) END AS sweetness, round(z / 20.0::DOUBLE, 4) AS tannin, z::DOUBLE AS judgments FROM w""")
def rating_prices_and_tastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ratings.entries(_payloads(base(spark, sf_dir)))
    taste = F.col("taste")
    return e.select("wine_id", F.size("prices").alias("prices"), F.array_min(F.transform("prices", lambda p: p["per_75cl"])).alias("cheapest"), F.round(taste["sweetness"], 4).alias("sweetness"), F.round(taste["tannin"], 4).alias("tannin"), taste["count"].alias("judgments"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 3 <> 0 THEN (2010 + p_size)::DOUBLE END AS first, CASE WHEN p_size % 3 = 1 THEN (2015 + p_size)::DOUBLE END AS last, CASE WHEN 45 + p_size BETWEEN 50 AND 100 THEN (45 + p_size)::DOUBLE END AS points FROM part")
def windows_and_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, = cols("z")
    html = F.when(Z % 3 == 0, F.lit("<p>none</p>")).otherwise(_text('{"drinking_window": {"start_year":', 2010 + Z, ', "end_year" : ', F.when(Z % 3 == 2, "null").otherwise((2015 + Z).cast("string")), "}}"))
    rows = base(spark, sf_dir).select("k", ratings.drinking_window(html).alias("w"), ratings.critic_points(_text("Note: ", 45 + Z, " Punkte von 100")).alias("points"))
    return rows.select("k", F.col("w.first").cast("double").alias("first"), F.col("w.last").cast("double").alias("last"), "points")


@query(f"WITH {BASE_SQL} SELECT k FROM w WHERE z % 3 = 0")
def same_house_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of entries of a producer's page those that share more with a name than the producer."""
    Z, A, B, C = cols("zabc")
    entry = F.struct(A.alias("winery"), F.when(Z % 3 == 0, _text(A, " ", B)).when(Z % 3 == 1, _text(A, " ", C)).otherwise(C).alias("wine_name"))
    return ratings.same_house_only(base(spark, sf_dir).select("k", _text(A, " ", B).alias("name"), entry.alias("entry"))).select("k")


@query("""WITH p AS (SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN '<p>Just A Moment' WHEN 1 THEN 'Unusual Traffic' WHEN 2 THEN 'captcha-delivery' ELSE '' END AS body FROM pages), l AS (SELECT page_id, lower(substr(body, 1, 200000)) AS t FROM p)
SELECT page_id, CASE WHEN contains(t, 'datadome') OR contains(t, 'captcha-delivery') THEN 'datadome' WHEN contains(t, 'cf-challenge') OR contains(t, 'just a moment') OR contains(t, 'cf_chl') THEN 'cloudflare'
  WHEN contains(t, 'access denied') OR contains(t, 'are you a robot') OR contains(t, 'unusual traffic') OR contains(t, 'incapsula') THEN 'bot protection' END AS block FROM l""")
def blocked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("page_id") % 5
    body = F.concat("html", F.when(kind == 0, "<p>Just A Moment").when(kind == 1, "Unusual Traffic").when(kind == 2, "captcha-delivery").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", pages.detect_block(body).alias("block"))


@query("""WITH l AS (SELECT DISTINCT url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT regexp_extract(url, '^[a-z]+://[^/]+') || href AS link, count(*) AS n FROM l WHERE starts_with(href, '/') GROUP BY 1""")
def absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", "html")
    found = pages.tiles(p, "a", {"href": "@href"}, keep=["url"]).where("href LIKE '/%'").select("url", "href").distinct()
    return found.select(pages.absolute_url(F.col("url"), F.col("href")).alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("n"))


_ENTRIES = {"defaults": {"vat_included": True, "price_basis": "auto", "adapter": "tile_shop"}, "retailers": {"a": {"name": "Shop A", "domain": "a.ch", "urls": ["https://a.ch/1"]}, "b": {"name": "Shop B", "enabled": False, "price_basis": "pack", "vat_included": None}, "c": {"vat_included": False, "private_labels": ["own"]}},
            "rating_sources": {"r": {"name": "Ratings", "enabled": True}}}


@query("""SELECT * FROM (VALUES ('a', 'Shop A', true, 'auto', true, 1, 0, 'retailer', true), ('b', 'Shop B', false, 'pack', true, 0, 0, 'retailer', false), ('c', 'c', true, 'auto', false, 0, 1, 'retailer', true), ('r', 'Ratings', true, 'auto', true, 0, 0, 'rating', false))
t(key, name, enabled, price_basis, vat_included, urls, labels, kind, chosen)""")
def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = registry.from_entries(spark, _ENTRIES)
    chosen = registry.select(r).select("key", F.lit(True).alias("chosen"))
    return r.join(chosen, "key", "left").select("key", "name", "enabled", "price_basis", "vat_included", F.size("urls").alias("urls"), F.size("private_labels").alias("labels"), "kind", F.coalesce("chosen", F.lit(False)).alias("chosen"))


@query(f"""WITH {BASE_SQL} SELECT k, CASE WHEN z % 10 = 0 THEN 4.9::DOUBLE ELSE z / 10.0::DOUBLE END AS rating, CASE WHEN z % 10 = 0 THEN 'https://r.example/' || k END AS url FROM w""")
def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, Z, A = cols("kza")  # a word of eight letters alone is met twice among a million items
    rows = base(spark, sf_dir).select("k", "z", _text(A, " ", K).alias("name_key"), (Z / 10.0).alias("rating"), F.lit(None).cast("string").alias("url"))
    checked = rows.where("z % 10 = 0").select("name_key", F.lit(4.9).alias("rating"), _text("https://r.example/", K).alias("url")).unionByName(rows.limit(1).select(F.lit(None).cast("string").alias("name_key"), F.lit(1.0).alias("rating"), F.lit("x").alias("url")))
    return registry.with_overrides(rows, checked, "name_key", ["rating", "url"]).select("k", "rating", "url")


@query("""WITH p AS (SELECT page_id % 12 AS source, CASE WHEN page_id % 12 IN (1, 2) THEN 'cloudflare' END AS block, CASE WHEN page_id % 12 IN (3, 4) THEN 404 ELSE 200 END AS status_code FROM pages),
o AS (SELECT s_suppkey % 12 AS source, count(*) AS n FROM supplier WHERE s_suppkey % 12 IN (1, 3, 5) GROUP BY 1)
SELECT p.source, coalesce(max(o.n), 0) AS offers, count(*) AS pages, CASE WHEN max(o.n) > 0 THEN 'ok' WHEN max(block) IS NOT NULL THEN 'blocked' WHEN sum(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) = count(*) THEN 'error' ELSE 'empty' END AS status FROM p LEFT JOIN o ON o.source = p.source GROUP BY 1""")
def fetch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("page_id") % 12
    p = table(spark, sf_dir, "pages").select(s.alias("source"), F.when(s.isin(1, 2), "cloudflare").alias("block"), F.when(s.isin(3, 4), 404).otherwise(200).alias("status_code"))
    o = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 12).alias("source")).where(F.col("source").isin(1, 3, 5))
    return registry.fetch_report(o, p).select("source", "offers", "pages", "status")


@query("""WITH n AS (SELECT l_suppkey AS source, count(*) AS read FROM lineitem GROUP BY 1) SELECT s_suppkey AS source, s_suppkey * 10 AS total, coalesce(read, 0) AS read, s_suppkey * 10 - coalesce(read, 0) AS gap FROM supplier LEFT JOIN n ON source = s_suppkey WHERE s_suppkey * 10 > coalesce(read, 0)""")
def incomplete_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), (F.col("s_suppkey") * 10).alias("total"))
    return registry.completeness(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source")), claimed).select("source", "total", "read", "gap")


@query("""WITH p AS (SELECT DISTINCT l_partkey AS item, l_suppkey AS s FROM lineitem), h AS (SELECT item, 'shop' || s || '.ch' AS h FROM p WHERE s % 2 = 0 UNION SELECT item, 'buy' || s || '.example' FROM p WHERE s % 3 <> 0)
SELECT item, string_agg(h, ' ' ORDER BY h) AS hosts FROM h GROUP BY 1""")
def own_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    prices = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), s.cast("string").alias("seller"), F.when(s % 3 != 0, _text("https://www.Buy", s, ".example/x?y=1")).alias("url"))
    reg = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("key"), _text("Shop", F.col("s_suppkey"), ".CH").alias("domain"))
    return registry.own_hosts(prices, reg).select("item", F.array_join("hosts", " ").alias("hosts"))


@query("SELECT l_suppkey AS seller, coalesce(s_name, CAST(l_suppkey AS VARCHAR)) AS seller_name, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = l_suppkey GROUP BY 1, 2")
def seller_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"))
    rows = registry.display_info(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("seller")), reg)
    return rows.groupBy(F.col("seller").cast("long").alias("seller"), "seller_name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH h AS (SELECT DISTINCT url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages) SELECT url, 2.0::DOUBLE * (row_number() OVER (PARTITION BY host ORDER BY url) - 1) AS start_second FROM h WHERE NOT contains(url, '/fr/')""")
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("url").distinct()
    files = urls.select(F.lower(F.try_parse_url("url", F.lit("HOST"))).alias("host")).distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /*/fr/\nDisallow: /fr/"))
    return registry.request_plan(pages.robots_allowed(urls, pages.robots_rules(files, "reader"))).select("url", "start_second")


@query("""WITH c AS (SELECT s_suppkey AS source, n AS position, 'https://s' || s_suppkey || '.example/' || n AS url, CASE WHEN s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND n = 0) THEN 404 ELSE 200 END AS status FROM supplier, range(0, 2) t(n))
SELECT s_suppkey AS source, coalesce((SELECT arg_min(url, position) FROM c WHERE c.source = s_suppkey AND status = 200), CASE WHEN s_suppkey % 8 = 0 THEN 'https://s' || s_suppkey || '.example/weinaktionen' END) AS url FROM supplier""")
def resolved_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(s.alias("source"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position"))
    configured = rows.select("source", "position", _text("https://s", F.col("source"), ".example/", F.col("position")).alias("url"))
    landed = configured.select("url", F.when((F.col("source") % 4 == 0) | ((F.col("source") % 4 == 1) & (F.col("position") == 0)), 404).otherwise(200).alias("status_code"))
    roots = rows.where("position = 0").select("source", F.explode(F.array(F.lit("/kontakt"), F.when(F.col("source") % 8 == 0, "/weinaktionen").otherwise("/x"))).alias("path")).select("source", _text("https://s", F.col("source"), ".example", F.col("path")).alias("link"))
    return registry.resolve_urls(configured, landed, roots)
