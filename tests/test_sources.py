import pytest
from pyspark.sql import functions as F

from offerlens.plans import flow
from offerlens.sources import adapters, leaflet, pages, registry, shops
from offerlens.streaming import ingest

HTML = """<html lang="de"><title>A &amp; B</title><div class="tile big"><a href="/w1">Wein 1</a><br><span class="p">12.50 statt 15.00</span></div>
<div class="tile"><a href="http://y.ch/w2">Wein 2</a></div><script id="d">[{"sku":1,"attributeInfo":2},"S1",[3],"x"]</script></html>"""


def test_tiles_links_and_payload(spark):
    p = spark.createDataFrame([("http://x.ch/a", HTML), ("http://x.ch/b", None)], "url string, html string")
    t = pages.tiles(p, "div.tile", {"name": "a", "href": "a@href", "price": ".p"}).orderBy("position").collect()
    assert [(r["name"], r["href"], r["price"]) for r in t] == [("Wein 1", "/w1", "12.50 statt 15.00"), ("Wein 2", "http://y.ch/w2", None)]
    assert {r["link"] for r in pages.links(p).collect()} == {"http://x.ch/w1", "http://y.ch/w2"}
    one = p.limit(1).select(pages.graph_objects(pages.script_payload(F.col("html"), 'id="d"'), ["sku"]), pages.title(F.col("html")), pages.page_lang(F.col("html"))).first()
    assert tuple(one) == (['{"sku": "S1", "attributeInfo": ["x"]}'], "A & B", "de")


@pytest.mark.parametrize(("text", "keyed", "want"), [
    ('[{"_1":2,"_3":4},"name","Wine","total",85]', True, ['{"name": "Wine", "total": 85}']),
    ('[{"name":1,"me":0},["Ref",2],"W"]', False, ['{"name": "W", "me": {"name": "W", "me": null}}']),
    ("no json", False, []), (None, True, []), ("[]", True, []),
])
def test_graphs(spark, text, keyed, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(pages.graph_objects(F.col("t"), ["name"], keyed)).first()[0] == want


def test_open_tags_are_closed_by_what_follows(spark):
    """Optional end tags: list items, table cells, options and paragraphs end where the next one starts."""
    page = "<ul><li class=a>one<li class=a>two <b>bold<li class=a>three</ul><table><tr><td class=a>x<td class=a>y<tr><td class=a>z</table><p class=a>p1<p class=a>p2<div class=a>d<p class=a>q</div><ul><li class=a>o<ul><li class=a>i</ul>r</ul>"
    got = pages.tiles(spark.createDataFrame([("u", page)], "url string, html string"), ".a", {}, keep=["url"]).orderBy("position").collect()
    assert [r["all_text"] for r in got] == ["one", "two bold", "three", "x", "y", "z", "p1", "p2", "d q", "q", "o i r", "i"]


def test_deep_pages_and_graphs(spark):
    deep = "<div>" * 10_000 + '<a class="t" href="/x">in</a>' + "</div>" * 10_000
    nested = "[" * 9000 + "]" * 9000
    df = spark.createDataFrame([("u", deep)], "url string, html string")
    assert pages.tiles(df, "a", {"href": "@href"}).first()["href"] == "/x"
    long_path = '[{"name":1},' + ",".join(str(i + 2) for i in range(50)) + ',"end"]'
    one = spark.createDataFrame([(nested, long_path)], "a string, b string").select(pages.graph_objects(F.col("a"), ["name"]), pages.graph_objects(F.col("b"), ["name"]), pages.embedded_objects(F.col("a"), ["x"])).first()
    assert tuple(one) == ([], ['{"name": null}'], [])


def test_selectors(spark):
    page = '<div class="t"><p><img alt="no"></p><div class="m x"><span><img alt="yes"></span></div><i class="k">a</i><i class="k">b</i><b></b></div>'
    t = pages.tiles(spark.createDataFrame([("u", page)], "url string, html string"), ".t", {"alt": "div.m img@alt", "all": ".k*", "first": "b|i.k", "none": "h1|h2"}, keep=["url"])
    assert tuple(t.select("alt", "all", "first", "none").first()) == ("yes", "a b", "a", None)


def test_embedded_objects(spark):
    df = spark.createDataFrame([('x = {"a": {"sku": 1, "t": "}"}}; y = {broken {"sku": 2}',)], "t string")
    assert df.select(pages.embedded_objects(F.col("t"), ["sku"])).first()[0] == ['{"sku": 1, "t": "}"}', '{"sku": 2}']


@pytest.mark.parametrize(("agent", "allowed"), [("mybot", {"/a/c": False, "/a/b": True, "/z?q=1": False, "/": True}), ("BadBot/1", {"/a/c": False, "/a/b": False, "/z?q=1": False, "/": False})])
def test_robots(spark, agent, allowed):
    files = spark.createDataFrame([("x.ch", "User-agent: *\nDisallow: /a # no\nAllow: /a/b$\nDisallow: /*?q=\n\nUser-agent: badbot\nDisallow: /\n")], "host string, body string")
    urls = spark.createDataFrame([("http://x.ch" + p,) for p in allowed], "url string")
    got = {r["url"][len("http://x.ch"):]: r["allowed"] for r in pages.robots_allowed(urls, pages.robots_rules(files, agent)).collect()}
    assert got == allowed


def test_blocks(spark):
    df = spark.createDataFrame([("<p>Just a moment...</p>",), ("DataDome",), ("<p>Wein</p>",), (None,)], "b string")
    assert [r[0] for r in df.select(pages.detect_block(F.col("b"))).collect()] == ["cloudflare", "datadome", None, None]


def test_offers_and_flow(spark, tmp_path):
    raw = spark.createDataFrame([("Rossetti Linda Bolgheri 2022 75 cl", 12.95, 15.0, "Parker 92/100"), ("Karton 6x75cl Montepulciano Farnese exkl. MwSt", 60.0, 80.0, ""), ("Bier hell", 2.0, None, "")], "name string, amount double, reference double, basis_text string")
    offers = adapters.make_offers(raw, adapters.Shop("coop", deny=["bier"], critics={"parker": "parker"}))
    got = {r["name"]: (r["price"], r["discount_percent"], r["critics"]) for r in offers.collect()}
    assert got["Karton 6x75cl Montepulciano Farnese exkl. MwSt"][:2] == (10.81, 25.0)
    assert got["Rossetti Linda Bolgheri 2022 75 cl"][2] == {"parker": 92.0}
    other = offers.withColumn("seller", F.lit("prodega")).withColumn("price", F.col("price") - 1)
    catalog = spark.createDataFrame([("e1", "Tenute Rossetti Linda Bolgheri", 2022, True, 4.2, 900, "https://r/x/w/77?year=2022")], "entry_id string, name string, vintage int, rated boolean, rating double, rating_count int, url string")
    keep = flow.tables_in(str(tmp_path / "kept"))
    result = flow.rate(offers.unionByName(other), catalog, keep=keep)
    scored = keep(flow.score(result.items, keep))
    rows = {r["name"]: r for r in scored.collect()}
    linda = rows["Rossetti Linda Bolgheri 2022 75 cl"]
    assert (linda["status"], linda["rating"], linda["best_price"], linda["cheapest_seller"], linda["entity"]) == ("exact", 4.2, 11.95, "prodega", "77")
    table = flow.flat(scored, ["coop", "prodega"])
    assert table.columns[-2:] == ["price_coop", "price_prodega"]
    flow.write_csv(table, str(tmp_path / "csv"))
    flow.write_snapshot(result.items.select("item", "best_price"), str(tmp_path / "snap"), "2026-01-01")
    flow.write_snapshot(result.items.select("item", "best_price").limit(1), str(tmp_path / "snap"), "2026-01-02")
    flow.write_snapshot(result.items.select("item", "best_price"), str(tmp_path / "snap"), "2026-01-02")
    assert spark.read.parquet(str(tmp_path / "snap")).groupBy("run_date").count().count() == 2
    assert flow.retain_snapshots(spark, str(tmp_path / "snap"), 1) == ["2026-01-01"]
    assert '"n":"Rossetti' in flow.page_json(result.items, {"name": "n", "best_price": "p"})


def test_rules_of_single_shops(spark):
    one = lambda *c: tuple(spark.range(1).select(*c).first())
    assert one(adapters.not_expired(F.lit("bis 1.2.2026"), F.to_date(F.lit("2026-02-02"))), adapters.not_expired(F.lit("?"), F.to_date(F.lit("2026-02-02")))) == (False, True)
    assert one(adapters.merchant_key(F.lit("Coop@home"), {}), adapters.merchant_key(F.lit("Otto's"), {"otto's": "ottos"})) == ("coophome", "ottos")
    assert one(adapters.strike_price(F.array(F.lit(30.0), F.lit(20.0)), F.lit(10.0), F.lit(50.0))) == (20.0,)
    assert one(adapters.bottles_from_url(F.lit("/x-3x2019-3x2020.html")), adapters.bottles_from_url(F.lit("/x"))) == (6, None)
    assert one(adapters.unit_price_agrees(F.lit(15.0), F.lit(750), F.lit(20.1)), adapters.unit_price_agrees(F.lit(15.0), F.lit(500), F.lit(20.0))) == (True, False)
    assert one(adapters.size_in_parentheses(F.lit("Rosé (50 cl)")), adapters.strip_origin(F.lit("Toskana, Chianti"), ["Toskana"])) == ("50 cl", "Chianti")
    assert one(adapters.now_and_before(F.lit("12.50 statt 15.00")))[0].asDict() == {"amount": 12.5, "reference": 15.0}
    a = spark.createDataFrame([(1,)], "v int")
    assert adapters.first_answer([a.limit(0), a.withColumn("v", F.lit(2)), a]).collect()[0]["v"] == 2
    with pytest.raises(ValueError, match="lacks"):
        adapters.require(a.withColumn("x", F.lit(None).cast("int")), ["x"])


def test_leaflet(spark):
    words = spark.createDataFrame([(1, "Rioja", 10.0, 100.0), (1, "Crianza", 40.0, 100.0), (1, "9.95", 12.0, 160.0), (1, "Merlot", 210.0, 100.0)], "page int, text string, x0 double, top double")
    anchors = spark.createDataFrame([(1, "a1", 10.0, 150.0), (1, "a2", 210.0, 150.0)], "page int, anchor string, x0 double, top double")
    assert {r["anchor"]: r["lines"] for r in leaflet.cells(words, anchors).collect()} == {"a1": ["Rioja Crianza", "9.95"], "a2": ["Merlot"]}
    urls = spark.createDataFrame([("http://x/2026-2_kw9.pdf",), ("http://x/2026-10_kw41.pdf",), ("http://x/2025-12.pdf",)], "url string")
    assert leaflet.newest_leaflet(urls).first()[0] == "http://x/2026-10_kw41.pdf"


def test_registry(spark, tmp_path):
    path = tmp_path / "r.yaml"
    path.write_text("defaults: {vat_included: true, price_basis: auto}\nretailers:\n  a: {name: A, domain: a.ch}\n  b: {enabled: false, vat_included: false, price_basis: null}\nrating_sources:\n  v: {}\n")
    reg = registry.load(spark, str(path))
    assert {r["key"]: (r["vat_included"], r["price_basis"]) for r in reg.where("kind = 'retailer'").collect()} == {"a": (True, "auto"), "b": (False, "auto")}
    assert [r["key"] for r in registry.select(reg).collect()] == ["a"]
    with pytest.raises(KeyError):
        registry.select(reg, ["zzz"])


def test_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'i' AS item, 5D AS price, timestamp'2026-01-01 10:00:00' AS fetched_at UNION ALL SELECT 'i', 5D, timestamp'2026-01-01 11:00:00' UNION ALL SELECT 'j', 7D, timestamp'2026-01-02 10:00:00'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.without_repeats(ingest.read_offers(spark, str(tmp_path / "in"), rows.schema), ["item"])
    ingest.write(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r["item"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["i", "j"]


def test_hosts_grapes_and_maturity_file(spark, tmp_path):
    from offerlens.operators import explore, maturity

    (tmp_path / "r.yaml").write_text("retailers:\n  a: {name: A, domain: A.ch}\n")
    reg = registry.load(spark, str(tmp_path / "r.yaml"))
    prices = spark.createDataFrame([(1, "a", "https://www.b.ch/x"), (1, "z", None)], "item int, seller string, url string")
    assert registry.own_hosts(prices, reg).first()["hosts"] == ["a.ch", "b.ch"]
    assert {r["seller_name"] for r in registry.display_info(prices, reg).collect()} == {"A", "z"}
    (tmp_path / "m.yaml").write_text("entries:\n- region: Wallis\n  wine_type: rot\n  maturity: {'2020': k, '2019': '*'}\n  quality: {'2020': 4}\n")
    assert sorted((r["vintage"], r["code"]) for r in maturity.load(spark, str(tmp_path / "m.yaml")).collect()) == [(2019, "*"), (2020, "k")]
    df = spark.createDataFrame([("Santi Nobile", "Appassimento Primitivo"), ("Primitivos", None)], "a string, b string")
    assert [r[0] for r in df.select(explore.grape_flags([F.col("a"), F.col("b")], {"p": "primitivo"})).collect()] == [["p"], []]


LANDED = "url string, html string"


def test_wholesaler_articles(spark):
    import html
    import json

    item = {"sKU": "1", "packagingLabel": "75 cl", "quantityUnit": {"code": "Z06", "number": 6}, "href": {"self": "/a/1"}, "article": {"articleNumber": "77", "articleGroup": {"translations": {"de": None, "fr": {"wording": "Vins rouges"}}}},
            "translations": {"de": None, "fr": {"advertisingText": "Rioja Crianza", "additionalDesignation": "2019", "brand": "Cune"}}, "mainArticleDetailPrice": {"salesPriceTTC": 72.0, "discountPriceTTC": 54.0}}
    unknown = item | {"sKU": "2", "quantityUnit": None, "packagingLabelPro": "Karton", "translations": {"de": {"description": "Merlot"}, "fr": None}}
    page = '<x pagination="' + html.escape(json.dumps({"items": [item, item, unknown, item | {"sKU": "3", "mainArticleDetailPrice": {"salesPriceTTC": 1.0}}]})) + '">'
    got = {r["name"]: r for r in shops.offers("wholesaler", spark.createDataFrame([("https://x/", page)], LANDED)).collect()}
    rioja, merlot = got["Rioja Crianza 2019 Cune, 75 cl"], got["Merlot, 75 cl"]
    assert (rioja["price"], rioja["units"], rioja["confidence"], rioja["discount_percent"], rioja["vintage"]) == (9.0, 6, "high", 25.0, 2019)
    assert (merlot["raw"], merlot["confidence"]) == (54.0, "low")
    assert len(got) == 2


def test_discounter_graph(spark):
    page = ('<script id="__NUXT_DATA__">[{"sku":1,"attributeInfo":2},"S1",[3,6,8,10,12],{"attributeName":"name","vals":4},[5],{"value":"Rioja","label":"Rioja"},{"attributeName":"category","vals":7},[{"value":"1","label":"Rotwein Weine"}],'
            '{"attributeName":"priceFormatted","vals":9},[{"value":"35.70","label":"x"}],{"attributeName":"box_item_count","vals":11},[{"value":"6","label":"6"}],{"attributeName":"content_size_text","vals":13},[{"value":"75 cl","label":"75 cl"}]]</script>')
    r = shops.offers("discounter", spark.createDataFrame([("https://x/", page)], LANDED)).first()
    assert (r["name"], r["price"], r["units"]) == ("Rioja", 5.95, 6)


def test_api_shop_products(spark):
    import json

    p = {"name": {"de-CH": "Chianti"}, "slug": {"de-CH": "chianti-1"}, "masterVariant": {"sku": "9", "published": True, "active": True, "price": {"initialPrice": {"amount": 2000}, "discountPrice": {"amount": 1500}, "literPrice": {"amount": 20.0}},
                                                                                       "attributes": {"producer": {"de": "Rocca"}, "bottleSize": 7500}}}
    dead = json.loads(json.dumps(p)); dead["masterVariant"]["active"] = False; dead["name"] = {"de": "Dead"}  # noqa: E702
    odd = json.loads(json.dumps(p)); odd["name"] = {"de": "Odd"}; odd["masterVariant"]["attributes"]["bottleSize"] = 5000  # noqa: E702
    rows = {r["name"]: r for r in shops.api_shop(spark.createDataFrame([("u", json.dumps([p, dead, odd]))], "url string, payload string")).collect()}
    assert {n: (r["amount"], r["reference"], r["basis_text"]) for n, r in rows.items()} == {"Chianti Rocca": (15.0, 20.0, "750 ml"), "Odd Rocca": (15.0, 20.0, "")}


def test_tile_shop_and_its_balance(spark):
    import html
    import json

    tile = lambda **k: 'x-data="product(' + html.escape(json.dumps({"id": "A 1 2020", "name": "Merlot", "description": "Ticino", "isSellable": True, "isSellableByUnit": True, "conditioningDetail": {"capacity": 75}, "packaging": {"unit": "B", "main": "K"},
        "packagingDetails": {"B": {"quantity": 1, "isSellable": True}, "K": {"quantity": 6, "isSellable": True}}, "price": {"B": "12.00", "K": "60"}, "insteadOfPrice": {"B": "20.00", "K": "80"}, "promotion": {"percent": "20", "regularPrice": {"B": "15.00"}}} | k), quote=True) + ')"'
    page = tile() + tile(name="Carton", isSellableByUnit=False, promotion={"percent": "25", "regularPrice": {}}) + tile(name="Beer", gAData={"items": [{"item_category": "Spirituosen"}]}) + 'x-data="product({&quot;broken)"' + 'x-data="product({&quot;a&quot;:})"'
    landed = spark.createDataFrame([("https://x/", page)], LANDED)
    got = {r["name"]: (r["amount"], r["reference"], r["basis_text"], r["vintage"]) for r in shops.tile_shop(landed).collect()}
    assert got == {"Merlot Ticino": (12.0, 15.0, "1 x 75 cl", 2020), "Carton Ticino": (60.0, 80.0, "Karton 6 x 75 cl", 2020)}
    assert tuple(shops.tile_balance(landed).select("expected", "read", "broken", "missed").first()) == (5, 4, 1, 1)
    assert {r["name"]: r["price"] for r in shops.offers("tile_shop", landed).collect()} == {"Merlot Ticino": 12.0, "Carton Ticino": 10.0}


def test_nested_shop_and_what_it_claims(spark):
    payload = '{"x":{"count":7,"data":[{"oldPrice":30,"price":20,"packaging":1,"title1":"Rocca","title3":"Il Sasso","slug":"s","size":{"name":"75 cl"},"year":{"name":"2019"}},{"oldPrice":10,"price":20,"packaging":1,"title1":"No"}]}}'
    landed = spark.createDataFrame([("u", payload)], "url string, payload string")
    assert [(r["name"], r["price"], r["vintage"]) for r in shops.offers("nested_shop", landed).collect()] == [("Il Sasso Rocca", 20.0, 2019)]
    assert shops.claimed_total(landed).first()["total"] == 7


def test_tile_readers(spark):
    land = lambda page: spark.createDataFrame([("https://x.ch/list", page)], LANDED)
    cellar = '<ol><li class="product-item"><a class="product-item-link" href="/rocca-il-sasso-3x2019-3x2020.html">Il Sasso</a><div class="price-box"><span class="special-price">CHF 60.00</span><span class="old-price">CHF 90.00</span></div><span class="cs-product-tile__attribute">Toskana</span><span class="cs-product-tile__attribute">2019</span></ol><input data-role="pager" max="55">'
    r = shops.cellar(land(cellar)).first()
    assert (r["name"], r["amount"], r["reference"], r["basis_text"], r["vintage"]) == ("Il Sasso (Rocca)", 60.0, 90.0, "Toskana 2019 Karton 6 x 75 cl", 2019)
    assert shops.last_page(land(cellar)).first()["last"] == 40
    boxed = '<div class="product-box"><a class="product-name" href="/p/1">Toskana – Il Sasso Riserva Speciale 2018</a><span class="product-description">Rocca</span><span class="product-price">CHF 12.00 statt CHF 18.00</span></div><div class="product-box"><a class="product-name" href="/p/2">Ohne Rabatt</a><span class="product-price">CHF 12.00</span></div>'
    r = shops.boxed_shop(land(boxed)).collect()
    assert [(x["name"], x["amount"], x["reference"], x["region"], x["vintage"], x["url"]) for x in r] == [("Il Sasso Riserva Speciale 2018 Rocca", 12.0, 18.0, "Toskana", 2018, "https://x.ch/p/1")]
    instead = '<div class="product"><a class="product__title" href="/a">Sasso</a><i class="product__producer">Rocca</i><b class="product__price">CHF 9.00 statt CHF 12.00</b><i class="product__bottle-size">75 cl</i><i class="product__vintage">2020</i></div><div class="product"><a class="product__title">No</a><b class="product__price">CHF 9.00</b></div>'
    assert [(x["name"], x["amount"], x["reference"], x["vintage"]) for x in shops.instead_shop(land(instead)).collect()] == [("Sasso Rocca", 9.0, 12.0, 2020)]
    village = '<div class="c-product"><a href="/v"><h3 class="c-product__title">Fendant <p>Wallis 2021</p></h3></a><div class="c-product__price">statt CHF 10.00 <span class="c-product__price-main">8.00</span></div><div class="c-product__description">Weiss (70 cl)</div></div>'
    assert [(x["name"], x["amount"], x["reference"], x["basis_text"], x["vintage"]) for x in shops.village_shop(land(village)).collect()] == [("Fendant", 8.0, 10.0, "70 cl", 2021)]
    outlet = '<div class="product-item"><a href="/o"><b class="product-name">Merlot</b></a><a class="product-desc-section">Rocca Rossa Tessin - rot</a><i class="product-price">CHF 15.00 / 75 cl</i><i class="product-instead-price">CHF 20.00</i><i class="product-liter-price">(CHF 20.00 / L)</i><i class="product-year">2017</i></div>'
    r = shops.outlet(land(outlet)).first()
    assert (r["name"], r["amount"], r["reference"], r["vintage"]) == ("Merlot Rocca Rossa", 15.0, 20.0, 2017) and "75 cl" in r["basis_text"]
    assert "75 cl" not in shops.outlet(land(outlet.replace("(CHF 20.00 / L)", "(CHF 33.00 / L)"))).first()["basis_text"]
    card = '<div class="card dealtype-deal" data-upox-id="5"><div class="card-image"><img alt="Rioja Reserva"></div><div class="card-merchant"><img alt="Otto\'s"></div><span class="price-new">7.95</span><span class="price-old">12.95</span><a href="/d">x</a><span class="card-date">bis 9.8.2026</span><p class="card-meta">75 cl</p></div>'
    day = lambda d: F.lit(d).cast("date")
    r = shops.aggregator(land(card), day("2026-08-01"), {"ottos": {"standard": "https://o.ch/s?q=:relevance:a&x=1"}}).first()
    assert (r["name"], r["seller"], r["amount"], r["reference"], r["article"], r["url"]) == ("Rioja Reserva", "ottos", 7.95, 12.95, "5", "https://o.ch/s?q=:relevance:a&x=1")
    assert shops.aggregator(land(card), day("2026-09-01")).count() == 0


def test_market_hits_and_precedence(spark):
    import json

    hit = {"vintage": {"year": "2019", "wine": {"id": 5, "name": "Sasso", "winery": {"name": "Rocca"}}, "statistics": {"ratings_average": 4.1, "ratings_count": 30}}, "price": {"id": 1, "amount": 20.0, "discounted_from": 30.0, "bottle_type": {"id": 1}, "bottle_quantity": 6, "url": "http://m/1"}}
    big = {**hit, "price": hit["price"] | {"id": 2, "bottle_type": {"id": 3}}}
    landed = spark.createDataFrame([("u", json.dumps([hit, hit, big]))], "url string, payload string")
    r = shops.market_hits(landed).collect()
    assert [(x["name"], x["amount"], x["url"], x["pack"], x["rating"]) for x in r] == [("Rocca Sasso", 20.0, "https://m/1", 6, 4.1)]
    fixed = spark.createDataFrame([("https://m/1", "Rocca Piccola")], "url string, name string")
    assert tuple(shops.market_hits(landed, fixed).select("name", "rating").first()) == ("Rocca Piccola", None)
    a = spark.createDataFrame([("c", 1.0)], "name string, amount double")
    names = lambda df: sorted(x["name"] for x in df.collect())
    assert names(shops.cash_and_carry(a, a.withColumn("name", F.lit("l")), a.withColumn("name", F.lit("w")))) == ["c", "w"]
    assert names(shops.cash_and_carry(a.limit(0), a.withColumn("name", F.lit("l")))) == ["l"]


def test_fetch_reports_every_source(spark):
    box = '<div class="product"><a class="product__title" href="/a">Sasso Rocca Merlot</a><b class="product__price">CHF 9.00 statt CHF 12.00</b></div>'
    landed = spark.createDataFrame([("a", "https://a/", box, 200), ("a", "https://a/2", "<p>Just a moment</p>", 200), ("b", "https://b/", "datadome", 403), ("c", "https://c/", "<p>", 200)], "source string, url string, html string, status_code int")
    offers, report = shops.fetch(landed, dict.fromkeys("abc", "instead_shop"))
    assert [(r["source"], r["price"]) for r in offers.collect()] == [("a", 9.0)]
    assert {r["source"]: r["status"] for r in report.collect()} == {"a": "ok", "b": "blocked", "c": "empty"}


def test_leaflet_cells_say_what_they_offer(spark):
    cells = spark.createDataFrame([(["Aktion", "75 cl", "statt 12.90", "9.95"], ["Rioja Reserva", "Spanien", "6 x 75 cl", "exklusive MwSt", "2019"]), (["kg", "9.95"], ["Käse"]), (["75 cl"], ["Merlot"])], "above array<string>, below array<string>")
    fields = leaflet.cell_fields(cells, ["spanien"])
    got = {r["name"]: (r["amount"], r["reference"], r["unit"], r["pack"]) for r in fields.collect()}
    assert got["Rioja Reserva"] == (9.95, 12.9, "75 cl", "6 x 75 cl")
    sure, unsure = leaflet.leaflet_records(fields)
    assert [r["name"] for r in sure.collect()] == ["Rioja Reserva"]
    assert {r["name"]: r["doubt"] for r in unsure.collect()} == {"Käse": "not by the bottle", "Merlot": "no price"}


def test_deep_links(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    pages_of = {"standard": "https://c.ch/s?q=%3Arelevance%3Asale%3Atrue&sort=x", "rot": "https://c.ch/rot"}
    assert one(adapters.promo_page(F.lit("Protos Roble – Rotwein"), pages_of)) == "https://c.ch/s?q=protos%20roble%3Arelevance%3Asale%3Atrue&sort=x"
    assert one(adapters.promo_page(F.lit("2019 – Rotwein"), {"rot": "https://c.ch/rot"})) == "https://c.ch/rot"
    assert one(adapters.promo_page(F.lit("x"), {})) is None


def test_replaced_folders_survive_a_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    flow.write_table(spark.range(3), path)
    with pytest.raises(Exception, match="bad"):
        flow.write_table(spark.range(3).withColumn("x", F.raise_error(F.lit("bad"))), path)
    assert spark.read.parquet(path).count() == 3
    flow.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def flow_catalog(spark):
    rows = [("e1", "Rocca Sasso", 2019, 4.4, 80, 4.0, 900, 1, "Rocca", "https://r/x/w/1"), ("e2", "Rocca Sasso Bianco", 2019, None, 0, 3.9, 50, 2, "Rocca", "https://r/x/w/2"), ("e3", "Luna Chiara", None, None, 0, 3.5, 3, 1, "Luna", "https://r/x/w/3"),
            ("e4", "Altro Vino Grigia", None, None, 0, 4.2, 300, 1, "Piccini", "https://r/x/w/4")]
    return spark.createDataFrame(rows, "entry_id string, name string, year int, vintage_avg double, vintage_count long, wine_avg double, wine_count long, type_id int, winery string, url string")


def test_ladder_in_the_flow(spark, tmp_path):
    raw = spark.createDataFrame([("Rocca Sasso 2019", 10.0), ("Rocca Sasso 2015 Rotwein", 9.0), ("Rocca Sasso Vino Blanco Bianco", 8.0), ("Luna Chiara", 7.0), ("Piccini Rosso", 6.0), ("Nichts davon", 5.0)], "name string, amount double")
    keep = flow.tables_in(str(tmp_path / "k"))
    items = flow.rate(adapters.make_offers(raw, adapters.Shop("a")), flow_catalog(spark), keep=keep).items
    got = {r["name"]: (r["status"], r["rating"]) for r in items.collect()}
    assert got["Rocca Sasso 2019"] == ("exact", 4.4)
    assert got["Rocca Sasso 2015 Rotwein"] == ("wine_level", 4.0)
    assert got["Rocca Sasso Vino Blanco Bianco"][0] in ("wine_level", "no_entry")
    assert got["Luna Chiara"] == ("too_few_ratings", None)
    assert got["Piccini Rosso"] == ("winery_level", 4.2)
    assert got["Nichts davon"] == ("no_entry", None)
    cache = spark.sql("SELECT 'nichts davon' AS name_key, CAST(NULL AS INT) AS vintage, 'wine_level' AS status, 'wine_level' AS confidence, 4.9D AS rating, 77L AS rating_count, 'https://r/x/w/9' AS url, timestamp'2026-01-01' AS fetched_at, CAST(NULL AS TIMESTAMP) AS retry_after")
    offers = adapters.make_offers(raw, adapters.Shop("a"))
    at = lambda d: F.lit(d).cast("timestamp")
    fresh = flow.rate(offers, flow_catalog(spark), keep=keep, cache=cache, now=at("2026-02-01")).items
    assert {r["name"]: r["rating"] for r in fresh.collect()}["Nichts davon"] == 4.9
    old = flow.rate(offers, flow_catalog(spark), keep=keep, cache=cache, now=at("2027-02-01")).items
    assert {r["name"]: r["rating"] for r in old.collect()}["Nichts davon"] is None
    assert flow.cache_rows(fresh, at("2026-02-01")).count() == 5


def test_searches_of_a_name_give_the_best(spark, tmp_path):
    from offerlens.operators import ladder

    shop = spark.createDataFrame([("s1", "Ribera Duero Protos Roble", None), ("s2", "Keiner", None)], "shop_id string, name string, vintage int")
    asks = {(r["shop_id"], r["query_no"]): (r["query"], r["by"]) for r in ladder.schedule(shop).collect()}
    short = asks["s1", 0][0]
    assert asks["s1", 1][0] == "ribera duero protos roble" and asks["s1", 2] == (short, "ratings_count")
    assert ("s2", 1) not in asks
    rows = [("ribera duero protos roble", "", "e1", "Protos 27", 4.2, 999), (short, "ratings_count", "e2", "Protos Roble", 3.9, 50), (short, "", "e3", "Anders", 3.9, 50)]
    results = spark.createDataFrame(rows, "query string, by string, entry_id string, name string, wine_avg double, wine_count long").withColumn("url", F.lit("https://r/x/w/1")).withColumn("year", F.lit(None).cast("int"))
    got = {r["shop_id"]: (r["status"], r["entry_id"], r["query_no"]) for r in flow.lookup(shop, results, keep=flow.tables_in(str(tmp_path))).collect()}
    assert got["s1"] == ("wine_level", "e2", 2)
    assert got["s2"][0] == "no_entry"


def test_groups_and_maturity_reach_the_scores(spark, tmp_path):
    from offerlens.operators import style

    rows = [(f"i{k}", f"Rioja Merlot {k}", 2019, "exact", "exact", 3.5 + k % 5 / 10, 100, 5.0 + k, [("coop" if k % 2 else "vivino", 5.0 + k, "high", "u")]) for k in range(30)]
    items = spark.createDataFrame(rows, "item string, name string, vintage int, status string, confidence string, rating double, rating_count int, best_price double, prices array<struct<seller:string,price:double,confidence:string,url:string>>").withColumn("style", F.lit("rot"))
    aliases = spark.createDataFrame([("rioja", "rioja")], "alias string, region string")
    tokens = spark.createDataFrame([("R", "rioja")], "region string, token string")
    table = spark.createDataFrame([("R", "rot", 2019, "k")], "region string, wine_type string, vintage int, code string")
    rich = flow.enrich(items, style.Lists(brands=["merlot 7"]), aliases, tokens, table, 2026)
    one = {r["item"]: r for r in rich.collect()}
    assert one["i7"]["kind"] == "fruchtsuess" and one["i1"]["kind"] == "unbekannt" and one["i1"]["region"] == "rioja"
    assert (one["i1"]["maturity"]["code"], one["i1"]["maturity"]["source"]) == ("k", "table")
    scored = {r["item"]: r for r in flow.score(rich, flow.tables_in(str(tmp_path)), ["vivino"]).collect()}
    assert scored["i1"]["world"] == "handel" and scored["i2"]["world"] == "marktplatz"
    assert scored["i1"]["ref_level"] == "region" and scored["i1"]["value_score"] is not None and scored["i1"]["value_score_all"] is not None
    listed = flow.full_list(flow.score(rich, marketplaces=["vivino"])).collect()
    assert sorted((r["world"], r["position"]) for r in listed) == [(w, k) for w in ("handel", "marktplatz") for k in range(1, 16)]
