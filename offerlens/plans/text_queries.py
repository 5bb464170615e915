"""Registered queries of the text, matching, maturity and page operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import prices as P, text as X, vocab
from ..operators import matching, maturity, regions
from ..sources import adapters, pages
from .queries import query
from .tables import table


@query("""WITH n AS (SELECT p_partkey AS item, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part),
t AS (SELECT item, list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('neu', 'pack', 'the', 'sa', 'co', 'field', 'blend', 'do')) AS w FROM n)
SELECT item, array_to_string(w, ' ') AS normalized_name, array_to_string(list_sort(w), ' ') || '|' || (item % 30 + 1990) AS key FROM t""")
def dedup_key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "p_name", "p_type", "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), X.normalized_name(name).alias("normalized_name"), X.dedup_key(name, F.col("p_partkey") % 30 + 1990).alias("key"))


@query("""WITH t AS (SELECT o_orderkey, ' Lot ' || o_orderkey || ' of ' || year(o_orderdate) || ', 75 cl ' AS t FROM orders)
SELECT o_orderkey, CAST(nullif(regexp_extract(t, '[^0-9](19[5-9][0-9]|20[0-3][0-9])[^0-9]', 1), '') AS INT) AS vintage FROM t""")
def vintage_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("Lot "), F.col("o_orderkey"), F.lit(" of "), F.year("o_orderdate"), F.lit(", 75 cl"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.extract_vintage(t).alias("vintage"))


@query("SELECT doc_id, md5(strip_accents(replace(lower(text), 'ß', 'ss'))) AS folded FROM documents")
def document_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query(r"""SELECT page_id, nullif(lower(regexp_extract(html, '(?i)<html[^>]*lang=["'']?([A-Za-z-]+)', 1)), '') AS lang,
  trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&quot;', '"'), '&#34;', '"'), '&#39;', ''''), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages""")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pages.page_lang(F.col("html")).alias("lang"), pages.title(F.col("html")).alias("title"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=')) AS links FROM pages WHERE html LIKE '%<a href=%'")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.tiles(table(spark, sf_dir, "pages").select("page_id", "html"), "a", {"href": "@href"})
    return found.groupBy("page_id").agg(F.count("href").alias("links"))


@query("SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', ''), '') AS host FROM pages")
def host_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", P.host(F.col("url")).alias("host"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT p_partkey AS item, contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt') AS private_label FROM part")
def private_label_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), X.private_label(F.col("p_name"), ["Ring", "bolt"]).alias("private_label"))


@query(r"SELECT p_partkey AS item FROM part WHERE regexp_matches(p_name, '\b(ring|widget|gear)\b') AND NOT regexp_matches(p_name, '\b(red|hot)\b')")
def word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(X.looks_like(F.col("p_name"), ["ring", "widget", "gear"], ["red", "hot"])).select(F.col("p_partkey").alias("item"))


_ALIASES = [("ring", "r1"), ("small ring", "r2"), ("widget", "w1"), ("red", "c1"), ("red widget", "w2"), ("blue", "c2"), ("gear", "g1")]


@query(f"""WITH a(alias, region) AS (VALUES {', '.join(map(str, _ALIASES))})
SELECT p_partkey AS item, (SELECT arg_max(region, (CASE WHEN p_name = alias THEN '1' ELSE '0' END) || lpad(CAST(length(alias) AS VARCHAR), 4, '0') || alias) FROM a WHERE contains(p_name, alias)) AS region FROM part""")
def region_longest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("region_name"))
    # of two aliases of one length the later in the alphabet wins
    return regions.assign(rows, spark.createDataFrame(_ALIASES, "alias string, region string")).select("item", "region")


@query("""WITH w AS (SELECT o_orderkey, year(o_orderdate) AS a, year(o_orderdate) + o_orderkey % 10 - 1 AS b FROM orders)
SELECT o_orderkey, CASE WHEN b < a THEN '' WHEN 1998 < a THEN 'g' WHEN 1998 > b THEN 'm' WHEN b > a AND 1998 < a + (b - a) / 2.0 THEN 'k' ELSE '*' END AS code FROM w""")
def drink_window_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", maturity.window_code(a, a + F.col("o_orderkey") % 10 - 1, F.lit(1998)).alias("code"))


_TOKENS = [("A", "ring"), ("B", "small ring"), ("C", "widget"), ("D", "gear"), ("E", "bolt")]
_TABLE = [(r, t, y, "gk*m"[(i + y) % 4]) for i, (r, t) in enumerate([("A", "rot"), ("A", "weiss"), ("B", "rot"), ("C", "rot"), ("C", "weiss"), ("D", "weiss")]) for y in range(2000, 2010)]


@query(f"""WITH tok(region, token) AS (VALUES {', '.join(map(str, _TOKENS))}), tab(region, wine_type, vintage, code) AS (VALUES {', '.join(map(str, _TABLE))}),
w AS (SELECT p_partkey AS id, p_name AS name, 2000 + p_size % 12 AS vintage, CASE p_size % 3 WHEN 0 THEN 'rot' WHEN 1 THEN 'weiss' ELSE 'unbekannt' END AS wine_type FROM part),
hit AS (SELECT w.*, tok.region, rank() OVER (PARTITION BY id ORDER BY length(token) DESC) AS r FROM w JOIN tok ON regexp_matches(name, '\\b' || token || '\\b')),
found AS (SELECT hit.id, tab.code, tab.region FROM hit JOIN tab ON tab.region = hit.region AND tab.vintage = hit.vintage AND (hit.wine_type = 'unbekannt' OR hit.wine_type = tab.wine_type) WHERE r = 1),
one AS (SELECT id, min(code) AS code FROM found GROUP BY id HAVING min(code) = max(code)) SELECT w.id, one.code FROM w LEFT JOIN one ON one.id = w.id""")
def maturity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (2000 + size % 12).alias("vintage"),
                                               F.when(size % 3 == 0, "rot").when(size % 3 == 1, "weiss").otherwise("unbekannt").alias("wine_type"))
    return maturity.lookup(rows, spark.createDataFrame(_TOKENS, "region string, token string"), spark.createDataFrame(_TABLE, "region string, wine_type string, vintage int, code string")).select("id", "code")


@query("""WITH o AS (SELECT o_orderkey, 40 + o_orderkey % 70 AS x, 45 + o_custkey % 50 AS y, 48 + o_orderkey % 60 AS z FROM orders)
SELECT o_orderkey, greatest(CASE WHEN x BETWEEN 50 AND 100 THEN CAST(x AS DOUBLE) END, CASE WHEN y BETWEEN 50 AND 100 THEN CAST(y AS DOUBLE) END) AS parker, CASE WHEN z BETWEEN 50 AND 100 THEN CAST(z AS DOUBLE) END AS suckling FROM o""")
def critic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several scores of a critic, under any of its names, the highest that lies in the scale."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    t = F.concat(F.when(key % 2 == 0, "Parker ").otherwise("PARKER: "), 40 + key % 70, F.lit("/100, James Suckling: "), 48 + key % 60, F.lit(" / 100; Wine Advocate "), 45 + cust % 50, F.lit("/100, 3/5 Gläser"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.critic_scores(t, {"parker": "parker", "wine advocate": "parker", "suckling": "suckling"}).alias("m"))
    return rows.select("o_orderkey", F.col("m")["parker"].alias("parker"), F.col("m")["suckling"].alias("suckling"))


@query("SELECT o_orderkey, o_orderkey + (o_orderkey % 100) / 100.0::DOUBLE AS amount FROM orders")
def parse_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("CHF "), F.replace(F.format_number(F.col("o_orderkey"), 0), F.lit(","), F.lit("'")), F.lit(","), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit(" statt 99"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.parse_price(t).alias("amount"))


@query("""WITH o AS (SELECT l_orderkey AS a, l_linenumber AS b, l_extendedprice AS p, CAST(l_quantity AS INT) AS q FROM lineitem), u AS (SELECT *, CASE WHEN b IN (1, 6) AND q <= 24 THEN q ELSE 1 END AS n FROM o)
SELECT a, b, round(p / n * (750.0::DOUBLE / CASE b WHEN 4 THEN 1500 WHEN 5 THEN 500 WHEN 7 THEN 3000 ELSE 750 END) * CASE WHEN b IN (5, 6) THEN 1.081::DOUBLE ELSE 1.0::DOUBLE END + 1e-9, 2) AS price,
  CASE WHEN b = 3 OR b IN (1, 6) AND q > 24 THEN 'low' WHEN b IN (1, 2) THEN 'high' ELSE 'medium' END AS confidence FROM u""")
def price_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices whose text states pack, size and tax: counts beyond a pack and cartons without a count make them unsure."""
    b, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    basis = (F.when(b == 1, F.concat(q, F.lit(" x 75 cl"))).when(b == 2, "75 cl (100 ml = 1.20)").when(b == 3, "Karton").when(b == 4, "Magnum").when(b == 5, "50 cl exkl. MwSt")
             .when(b == 6, F.concat(q, F.lit("er Karton exkl. MwSt"))).otherwise("3 l Bag-in-Box"))
    rows = P.with_normalized_price(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), "l_extendedprice", basis, "p")
    return rows.select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("p.price").alias("price"), F.col("p.confidence").alias("confidence"))


@query("SELECT p_partkey AS item, 'https://search.example/?q=' || replace(p_name, ' ', '+') || '%23' || p_size AS url FROM part")
def search_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), X.search_url("https://search.example/?q=", F.concat("p_name", F.lit("#"), "p_size")).alias("url"))


_ROBOTS = [("/fr/", False), ("/fr/8*", True), ("/*?page=", False), ("/*/fr/", False), ("/es/1$", False)]


@query(f"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/?#]+', '') AS path, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host FROM pages),
r(pattern, regex, allow) AS (VALUES ('/fr/', '^/fr/.*', false), ('/fr/8*', '^/fr/8.*.*', true), ('/*?page=', '^/.*\\?page=.*', false), ('/*/fr/', '^/.*/fr/.*', false), ('/es/1$', '^/es/1$', false)),
hit AS (SELECT page_id, arg_max(allow, length(pattern) * 10 + CASE WHEN allow THEN 1 ELSE 0 END) AS allowed FROM p JOIN r ON regexp_matches(split_part(path, '#', 1), regex) WHERE length(host) % 2 = 0 GROUP BY 1)
SELECT p.page_id, coalesce(hit.allowed, true) AS allowed FROM p LEFT JOIN hit ON hit.page_id = p.page_id""")
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with names of an even length state rules, those of the others are for another agent."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = "".join(f"{'Allow' if allow else 'Disallow'}: {pattern}\n" for pattern, allow in _ROBOTS)
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    files = p.select(host.alias("host")).distinct().withColumn("body", F.when(F.length("host") % 2 == 0, "User-agent: other\nDisallow: /\n\nUser-agent: *\n" + rules).otherwise("User-agent: other\n" + rules))
    return pages.robots_allowed(p, pages.robots_rules(files, "reader")).select("page_id", "allowed")


@query("""SELECT DISTINCT p_name || ' ' || p_brand AS shop_id, p_brand || ' ' || p_name AS entry_id FROM part""")
def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name finds its own entry among all others, which share one or two of its words."""
    names = table(spark, sf_dir, "part").select("p_name", "p_brand").distinct()
    shop = names.select(F.concat_ws(" ", "p_name", "p_brand").alias("shop_id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.lit(None).cast("int").alias("vintage"))
    entries = names.select(F.concat_ws(" ", "p_brand", "p_name").alias("entry_id"), F.concat_ws(" ", F.lit("house"), "p_brand", "p_name").alias("name"), F.lit(None).cast("int").alias("vintage"), F.lit(False).alias("rated"))
    own = vocab.Vocabulary(regions=vocab.WINE.regions | {"brand", "house"})
    return matching.rank(matching.link(shop, entries, own)).where("position = 1").select("shop_id", "entry_id")


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS t FROM pages), n AS (SELECT page_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS name FROM l)
SELECT DISTINCT name, round(page_id % 50 + 5.0::DOUBLE + 1e-9, 2) AS price FROM n WHERE name <> '' AND regexp_full_match(name, '[A-Za-z]+')""")
def shop_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages as raw records through the offer constructor, one offer per name and price (names of plain letters)."""
    t = pages.tiles(table(spark, sf_dir, "pages").select("page_id", "html"), "a", {"name": "a"}).select(
        F.col("all_text").alias("name"), (F.col("page_id") % 50 + 5.0).alias("amount"), F.concat(F.lit("/"), F.col("page_id")).alias("url"), F.concat(F.lit("p"), F.col("page_id")).alias("article"), "position").where(F.col("name").rlike("^[A-Za-z]+$"))
    return adapters.build_offers(t, adapters.Shop("pages")).select("name", "price").distinct()
