"""Registered queries of rules on names, matches, styles, maturity, runs and outputs, over names made from the tables' rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import prices as P, text as X
from ..operators import explore, ladder, matching, maturity, merge, regions, resolve, scores, snapshots, style
from ..sources import leaflet, ratings
from . import flow, tables as T
from .queries import query
from .record_queries import BASE_SQL, _text, base, cols
from .tables import ALL_SQL, EFFECTIVE_SQL, OFFERS_SQL, offers, score_sql, table


def _joined(c: Column) -> Column:
    return F.array_join(c, " ")


# names

@query(f"""WITH {BASE_SQL}, n AS (SELECT *, z % 2 = 0 AS p FROM w)
SELECT k, 'Weingut ' || a || CASE WHEN p THEN '  Riserva ' ELSE ' Riserva ' END || c || ' DOC 2019 6 x 75 cl' AS bare, a || ' riserva ' || c AS tokens, 'weingut ' || a || CASE WHEN p THEN ' ' || b ELSE '' END || ' riserva ' || c AS business,
  a || ' ' || c AS distinctive, a || CASE WHEN p THEN ' ' || b ELSE '' END || ' ' || c AS query, a || CASE WHEN p THEN ' ' || b ELSE '' END || ' riserva ' || c AS long_query, a || CASE WHEN p THEN ' ' || b ELSE '' END || ' ' || c AS short_query,
  a || ' ' || c AS plain FROM n""")
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B, C = cols("zabc")
    name = _text("Weingut ", A, F.when(Z % 2 == 0, _text(" (", B, ")")).otherwise(""), " Riserva ", C, " DOC 2019 6 x 75 cl")
    rows = base(spark, sf_dir).withColumn("n", name)
    n = F.col("n")
    return rows.select("k", X.strip_alias(n).alias("bare"), _joined(X.tokenize(n)).alias("tokens"), _joined(X.tokenize_keep_producer(n)).alias("business"), _joined(X.distinctive_tokens(n)).alias("distinctive"), _joined(X.query_tokens(n)).alias("query"),
                       X.build_query(n).alias("long_query"), X.short_query(n).alias("short_query"), _joined(X.tokenize(n, keep_discriminating=False)).alias("plain"))


_STYLES = [("Rosso", "rot"), ("Bianco", "weiss"), ("Rosé", "rose"), ("Champagne", "champagner"), ("Prosecco", "schaumwein"), ("Passito", "suesswein"), ("Merlot", "rot"), ("Riesling", "weiss"), ("", "unbekannt"), ("Rouge Blanc", "unbekannt")]
_COUNTRIES = [("Italien", "", "Italien"), ("", "Rioja Alta", "Spanien"), ("Suisse", "Rioja", "Schweiz"), ("", "", ""), ("", "Steiermark", "Österreich"), ("", "Graubünden", "Schweiz")]


@query(f"""WITH {BASE_SQL}, s(i, style) AS (VALUES {', '.join(f"({i}, '{s}')" for i, (_, s) in enumerate(_STYLES))}), c(j, country) AS (VALUES {', '.join(f"({j}, '{c}')" for j, (_, _, c) in enumerate(_COUNTRIES))})
SELECT k, CASE WHEN z % 10 = 8 AND z % 3 = 0 THEN 'weiss' WHEN z % 10 = 3 THEN 'champagner' ELSE style END AS style, country, CASE z % 10 WHEN 0 THEN 'rot' WHEN 1 THEN 'weiss' END AS colour, CASE WHEN z % 4 = 0 THEN 'rot' WHEN z % 4 = 1 THEN 'weiss' WHEN z % 4 = 2 THEN 'rose' END AS stated
FROM w JOIN s ON i = z % 10 JOIN c ON j = z % 6""")
def styles_and_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A = cols("za")
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key + 1).cast("int"))
    rows = base(spark, sf_dir).withColumns({"n": _text(F.initcap(A), " ", pick([s for s, _ in _STYLES], Z % 10)), "t": F.when((Z % 10 == 8) & (Z % 3 == 0), 2).when(Z % 10 == 3, 3)})
    land = X.country(_text(A, " ", pick([n for n, _, _ in _COUNTRIES], Z % 6)), pick([r for _, r, _ in _COUNTRIES], Z % 6))
    colour = F.array_max(F.transform(X.tokenize(F.col("n")), lambda w: X.colour_group(w)))
    stated = X.colour_from_text(_text(A, pick([" Rotwein", " Vin Blanc", " Roséwein", ""], Z % 4)))
    return rows.select("k", X.wine_style(F.col("n"), F.col("t")).alias("style"), land.alias("country"), F.when((Z % 10).isin(0, 1), colour).alias("colour"), stated.alias("stated"))


@query(f"""WITH {BASE_SQL} SELECT k, upper(left(a, 1)) || substr(a, 2) || CASE WHEN z % 4 = 3 THEN ' (' || b || ')' ELSE '' END AS shown, b || CASE WHEN z % 2 = 0 THEN '' ELSE ' ' || c END AS uncoloured, CASE WHEN z % 2 = 0 THEN b || ' ' || a ELSE a || ' ' || b END AS entry, 'muller ' || replace(replace(a, 'ae', 'a'), 'oe', 'o') AS folded FROM w""")
def shown_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B, C = cols("zabc")
    tail = F.when(Z % 4 == 0, " – Rotwein, Italien (75 cl)").when(Z % 4 == 1, " - Weisswein, Schweiz").when(Z % 4 == 2, ", 75 cl").otherwise(_text(" (", B, ") (2019)"))
    entry = F.struct(B.alias("winery"), F.when(Z % 2 == 0, A).otherwise(_text(A, " ", B)).alias("wine_name"))
    return base(spark, sf_dir).select("k", X.display_name(_text(F.initcap(A), tail)).alias("shown"), ladder.colourless(_text(B, " Rosso", F.when(Z % 2 == 0, "").otherwise(_text(" ", C)))).alias("uncoloured"),
                                      ratings.display_name(entry).alias("entry"), X.umlauts_to_vowels(_text(F.when(Z % 2 == 0, "Müller ").otherwise("Mueller "), A)).alias("folded"))


@query("""SELECT o_orderkey, regexp_replace(printf('%.2f', o_totalprice), '\\.?0+$', '') AS plain, 'CHF ' || replace(format('{:,.2f}', o_totalprice), ',', '''') AS francs, strftime(o_orderdate, '%-d.%-m.%Y') AS day,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE printf('%.1f', 1 + (o_orderkey % 40) / 10.0) || '/5' || CASE WHEN o_custkey % 3 > 0 THEN ' (' || o_custkey % 3 || ')' ELSE '' END END AS rating, CASE WHEN length(o_orderpriority) <= 8 THEN o_orderpriority ELSE rtrim(left(o_orderpriority, 7)) || '…' END AS short FROM orders""")
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    value = F.when(key % 5 != 0, 1 + (key % 40) / 10)
    return o.select("o_orderkey", X.format_number(F.col("o_totalprice")).alias("plain"), X.format_chf(F.col("o_totalprice")).alias("francs"), X.format_date(F.col("o_orderdate")).alias("day"),
                    X.rating_text(value, 5, (F.col("o_custkey") % 3).cast("string")).alias("rating"), X.truncate(F.col("o_orderpriority"), 8).alias("short"))


@query("""SELECT p_partkey AS k, CASE p_size % 4 WHEN 0 THEN p_size + 1000.5::DOUBLE WHEN 1 THEN p_size + 0.25::DOUBLE END AS number, CASE WHEN p_size % 4 < 3 THEN p_size::DOUBLE END AS whole, CASE WHEN p_size % 4 = 0 THEN (2000 + p_size % 30)::DOUBLE END AS year FROM part""")
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, = cols("z")
    kind = Z % 4
    number = F.when(kind == 0, _text("1'", F.lpad(Z.cast("string"), 3, "0"), ",5")).when(kind == 1, _text(" ", Z, ".25")).when(kind == 2, "-3").otherwise("many")
    number = F.when(kind == 0, F.concat(F.lit("1'0"), F.lpad(Z.cast("string"), 2, "0"), F.lit(",5"))).otherwise(number)
    whole = F.when(kind == 0, _text(Z, ".9")).when(kind == 3, "x").otherwise(Z.cast("string"))
    year = F.when(kind == 0, _text(2000 + Z % 30)).when(kind == 1, "N.V.").when(kind == 2, "0").otherwise(_text(3000 + Z))
    return base(spark, sf_dir).select("k", X.positive_number(number).alias("number"), X.whole_number(whole).cast("double").alias("whole"), X.year(year).cast("double").alias("year"))


@query("""SELECT l_orderkey AS a, l_linenumber AS b, CASE WHEN l_quantity > 1 THEN 'Karton ' || CAST(l_quantity AS INT) || ', ' ELSE '' END || CASE l_linenumber % 3 WHEN 1 THEN '150 cl, ' WHEN 2 THEN '37.5 cl, ' ELSE '' END || CASE WHEN l_returnflag = 'N' THEN 'inkl. MwSt' ELSE 'exkl. MwSt' END AS basis FROM lineitem""")
def price_basis_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber") % 3
    ml = F.when(n == 1, 1500).when(n == 2, 375).otherwise(750)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), P.describe_basis(F.col("l_quantity").cast("int"), ml, F.col("l_returnflag") == "N").alias("basis"))


# matching: (shop, entry, entry's year, rated, matched, confidence); capital letters stand for an item's words
_CASES: list[tuple[str, str, int | None, bool, bool, str]] = [
    ("A B C 2019", "A B C", 2019, True, True, "exact"), ("A B C 2019", "A B C", 2018, True, True, "wine_level"), ("A B C 2019", "A B C", None, False, True, "wine_level"), ("A B C brut", "A B C", None, False, True, "wine_level"),
    ("A B C brut", "A B C extra", None, False, False, "none"), ("A B C riserva", "A B C", None, False, False, "none"), ("A B C rosso", "A B C bianco", None, False, False, "none"), ("A B rosso", "A B", None, False, True, "wine_level"),
    ("A B", "C D", None, False, False, "none"), ("A B", "A C", None, False, False, "none"), ("A B", "D A B", None, False, False, "none"), ("A B", "A B C", None, False, False, "none"), ("A B C", "A B C D", None, False, True, "fuzzy"),
    ("A B C", "D Weingut A B C", None, False, False, "none"), ("Weingut A B", "Weingut A B", None, False, True, "wine_level"), ("A", "A", None, False, True, "wine_level"), ("A", "A B", None, False, False, "none"), ("Rosso", "Rosso", None, False, False, "none"),
    ("A (B) C", "A B C", None, False, True, "wine_level"), ("", "A", None, False, False, "none"), ("Weingut A B C", "D A B C Weingut", None, False, False, "none")]


def _spelt(i: int, side: int) -> Column:
    A, B, C, D = cols("abcd")
    words = {"A": A, "B": B, "C": C, "D": D}
    parts: list[str | Column] = []
    for ch in _CASES[i][side]:
        parts.append(words.get(ch, ch))
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)) if parts else F.lit("")


def _case(side: int) -> Column:
    K, = cols("k")
    out = F.lit(None).cast("string")
    for i in range(len(_CASES)):
        out = F.when(K % len(_CASES) == i, _spelt(i, side)).otherwise(out)
    return out


def _told(values: list, kind: str) -> Column:
    K, = cols("k")
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), (K % len(_CASES) + 1).cast("int"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).select("k", _case(0).alias("shop"), _case(1).alias("entry"), _told([c[2] for c in _CASES], "int").alias("year"), _told([c[3] for c in _CASES], "boolean").alias("rated"))
    named = rows.select("k", matching.name_columns(F.col("shop")).alias("x"), matching.name_columns(F.col("entry"), F.col("year")).alias("y"), "rated")
    return named.withColumn("may", matching.may_match(F.col("x"), F.col("y"))).withColumn("d", matching.decide()(F.col("x"), F.col("y"), F.col("rated")))


@query(f"""WITH c(i, matched, confidence) AS (VALUES {', '.join(f"({i}, {c[4]}, '{c[5]}')" for i, c in enumerate(_CASES))}) SELECT p_partkey AS k, matched, confidence FROM part JOIN c ON i = p_partkey % {len(_CASES)}""")
def matching_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades, colours, missing anchors, rivals, prefixes, strangers, words ahead of the business or the producer, too little in common, and the confidences."""
    return _decided(spark, sf_dir).select("k", "d.matched", "d.confidence")


@query("SELECT count(*) AS lost FROM (SELECT 1 WHERE false)")
def word_rules_lose_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules on word sets that run before the matcher never exclude what it accepts."""
    return _decided(spark, sf_dir).where("d.matched AND NOT may").agg(F.count(F.lit(1)).alias("lost"))


@query(f"""WITH {BASE_SQL} SELECT k, z % 4 < 2 AS matched FROM w""")
def winery_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A, B, C, D = cols("zabcd")
    name = F.when(Z % 4 == 0, _text("Weingut ", A, " ", B)).when(Z % 4 == 1, _text(A, " ", B, " Rosso")).when(Z % 4 == 2, _text(A, " ", B, " ", C)).otherwise(D)
    rows = base(spark, sf_dir).select("k", matching.name_columns(name).alias("x"), matching.name_columns(_text(A, " ", B)).alias("y"))
    return rows.select("k", matching.decide(winery=True)(F.col("x"), F.col("y"), F.lit(False))["matched"].alias("matched"))


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names, and a catalog in which each finds by its number: its wine, two alike ones, two colours, a producer, few ratings, or nothing."""
    K, Z, A, B, C, D = cols("kzabcd")
    rows = base(spark, sf_dir)
    shop = rows.select(K.cast("string").alias("shop_id"), F.when(K % 7 == 4, _text("Weingut ", A, " ", B)).otherwise(_text(A, " ", B, F.when(K % 7 == 3, " Rosso").otherwise(""))).alias("name"), F.when(Z % 2 == 0, 2019).alias("vintage"))
    facts = lambda no, name, type_id, year, avg, count: F.struct(F.concat_ws("-", K, F.lit(no)).alias("entry_id"), name.alias("name"), F.lit(type_id).cast("int").alias("type_id"), F.lit(year).cast("int").alias("year"), F.lit(avg).cast("double").alias("vintage_avg"),
                                                              F.lit(count).cast("long").alias("vintage_count"), F.lit(3.5).alias("wine_avg"), F.when(K % 7 == 5, 2).otherwise(900).cast("long").alias("wine_count"))
    own, none = _text(A, " ", B), F.array().cast("array<struct<entry_id:string,name:string,type_id:int,year:int,vintage_avg:double,vintage_count:bigint,wine_avg:double,wine_count:bigint>>")
    entries = (F.when(K % 7 == 0, F.array(facts(0, own, 1, 2019, 4.1, 50))).when(K % 7 == 1, F.array(facts(0, own, 1, 2018, 4.1, 50))).when(K % 7 == 2, F.array(facts(0, _text(A, " ", B, " Rosso"), 1, None, None, None), facts(1, _text(A, " ", B, " Bianco"), 2, None, None, None)))
               .when(K % 7 == 3, F.array(facts(0, own, 2, None, None, None))).when(K % 7 == 4, F.array(facts(0, _text(C, " ", D), 1, None, None, None))).when(K % 7 == 5, F.array(facts(0, own, None, None, None, None))).otherwise(none))
    catalog = rows.select("k", "a", "b", F.explode(entries).alias("e")).select("e.*", F.when(F.col("k") % 7 == 4, _text(A, " ", B)).alias("winery"), _text("https://r.example/x/w/", F.col("k")).alias("url"))
    return shop, flow.as_catalog(catalog)


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS VARCHAR) AS shop_id, CASE k % 7 WHEN 0 THEN CASE WHEN z % 2 = 0 THEN 'exact' ELSE 'wine_level' END WHEN 1 THEN 'wine_level' WHEN 4 THEN 'winery_level' WHEN 5 THEN 'too_few_ratings' ELSE 'no_entry' END AS status,
  CASE k % 7 WHEN 0 THEN CASE WHEN z % 2 = 0 THEN 4.1::DOUBLE ELSE 3.5::DOUBLE END WHEN 1 THEN 3.5 WHEN 4 THEN 3.5 END AS rating, CASE WHEN k % 7 IN (0, 1, 4, 5) THEN k || '-0' END AS entry_id FROM w""")
def status_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From names to a status: another colour and undecidable colours go first, then the vintage's rating, the wine's, the producer's, too few, none."""
    shop, catalog = _catalog(spark, sf_dir)
    return flow.classify(shop, catalog)[0].select("shop_id", "status", "rating", "entry_id")


@query(f"""WITH {BASE_SQL} SELECT k || '-' || CASE WHEN z % 3 = 0 THEN 'y' ELSE 'x' END AS entry_id, CAST(k AS VARCHAR) AS shop_id, CASE WHEN z % 3 = 0 THEN 1 ELSE 0 END AS query_no FROM w""")
def search_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's short search finds its wine, or only a similar one while the long search finds it; the first best search counts."""
    K, Z, A, B, C, D = cols("kzabcd")
    shop = base(spark, sf_dir).select(K.cast("string").alias("shop_id"), _text(A, " ", B, " ", C, " Superiore").alias("name"), F.lit(None).cast("int").alias("vintage"), "k", "z", "a", "b", "c", "d")
    short, long = _text(A, " ", B, " ", C), _text(A, " ", B, " ", C, " superiore")
    hit = lambda q, by, no, name: F.struct(q.alias("query"), F.lit(by).alias("by"), F.concat_ws("-", K, F.lit(no)).alias("entry_id"), name.alias("name"))
    right, wrong = _text(A, " ", B, " ", C, " Superiore"), _text(A, " ", B, " ", C, " Superiore ", D)
    hits = F.when(Z % 3 == 0, F.array(hit(short, "", "x", wrong), hit(long, "", "y", right))).otherwise(F.array(hit(short, "", "x", right), hit(long, "", "y", right), hit(short, "ratings_count", "x", right)))
    results = shop.select(F.explode(hits).alias("h")).select("h.*", F.lit(4.0).alias("wine_avg"), F.lit(99).cast("long").alias("wine_count"), F.lit("https://r.example/w/1").alias("url"), F.lit(None).cast("int").alias("year"))
    return flow.settled(spark, lambda keep: flow.lookup(shop.select("shop_id", "name", "vintage"), results, keep=keep).select("shop_id", "entry_id", "query_no"))


@query(f"""WITH {BASE_SQL} SELECT k, CASE WHEN z % 4 = 0 OR z % 4 = 1 AND z % 3 = 0 THEN 'look up' ELSE 'cached' END AS how FROM w""")
def cached_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a cache answers and names to look up: by the normalised name and the year, while an entry is valid."""
    Z, A, B = cols("zab")
    rows = base(spark, sf_dir)
    shop = rows.select("k", _text("Weingut ", A, " ", B).alias("name"), F.when(Z % 2 == 0, 2019).alias("vintage"))
    age = F.when((Z % 4 == 1) & (Z % 3 == 0), 40).otherwise(20)
    cache = rows.where("z % 4 <> 0").select(_text(A, " ", B).alias("name_key"), F.when(Z % 2 == 0, 2019).alias("vintage"), F.when(Z % 4 == 1, "no_entry").otherwise("exact").alias("status"),
                                            F.date_sub(F.lit("2026-01-01").cast("date"), age).cast("timestamp").alias("fetched_at"), F.lit(None).cast("timestamp").alias("retry_after"), F.lit(4.0).alias("rating"))
    hit, todo = flow.cached_first(shop, cache, F.lit("2026-01-01").cast("timestamp"))
    return hit.select("k", F.lit("cached").alias("how")).unionByName(todo.select("k", F.lit("look up").alias("how")))


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS VARCHAR) AS shop_id, CASE WHEN z % 3 = 0 THEN 'wine_level' ELSE 'no_entry' END AS status, CASE WHEN z % 3 = 0 THEN 4.0::DOUBLE END AS rating FROM w""")
def producer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without an entry find it on their producer's page, if it shares more with them than the producer."""
    K, Z, A, B, C, D = cols("kzabcd")
    rows = base(spark, sf_dir)
    shop = rows.select(K.cast("string").alias("shop_id"), _text(A, " ", B).alias("name"), F.lit(None).cast("int").alias("vintage"))
    facts = [F.lit(None).cast("int").alias("year"), F.lit(4.0).alias("wine_avg"), F.lit(50).cast("long").alias("wine_count"), F.lit("https://r.example/w/1").alias("url")]
    page = rows.select(F.concat_ws("-", K, F.lit("p")).alias("entry_id"), _text(A, " ", F.when(Z % 3 == 0, B).otherwise(C)).alias("name"), A.alias("winery"), *facts)
    other = flow.as_catalog(rows.select(F.concat_ws("-", K, F.lit("o")).alias("entry_id"), _text(D, " ", C).alias("name"), *facts))
    named = rows.select(K.cast("string").alias("shop_id"), A.alias("winery"))

    def found(keep: flow.Keep) -> DataFrame:
        told, _ = flow.classify(shop, other, keep=keep)
        return flow.house_fallback(told, shop, named, page, keep=keep).select("shop_id", "status", "rating")

    return flow.settled(spark, found)


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS VARCHAR) AS shop_id, (45 + z)::DOUBLE AS points, CASE WHEN z % 2 = 0 THEN 'exact' ELSE 'wine_level' END AS status FROM w WHERE 45 + z BETWEEN 50 AND 100""")
def critic_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    K, Z, A, B, C = cols("kzabc")
    rows = base(spark, sf_dir)
    shop = rows.select(K.cast("string").alias("shop_id"), _text(A, " ", B, " ", C).alias("name"), F.lit(2019).alias("vintage"))
    catalog = rows.select(K.cast("string").alias("entry_id"), _text(A, " ", B, " ", C).alias("name"), F.when(Z % 2 == 0, 2019).otherwise(2017).alias("vintage"), (45 + Z).alias("points"), F.lit("u").alias("url"))
    return flow.critic_lookup(shop, catalog).select("shop_id", "points", "status")


# styles

_LISTS = style.Lists(sweet=["dolce", "lieblich"], brands=["apothic"], no_origin=["vino d'italia"], styles={"Bold Red": "weich_modern"})


@query(f"""WITH {BASE_SQL} SELECT k, CASE z % 10 WHEN 0 THEN 'fruchtsuess' WHEN 1 THEN 'fruchtsuess' WHEN 2 THEN 'fruchtsuess' WHEN 3 THEN 'straff_herb' WHEN 4 THEN 'fruchtsuess' WHEN 5 THEN CASE WHEN z % 3 = 0 THEN 'weich_modern' ELSE 'fruchtsuess' END
  WHEN 6 THEN 'fruchtsuess' WHEN 7 THEN 'straff_herb' WHEN 8 THEN 'weich_modern' ELSE 'unbekannt' END AS typ, CASE WHEN z % 10 < 5 OR z % 10 = 5 AND z % 3 <> 0 THEN 1 WHEN z % 10 = 9 THEN 0 ELSE 2 END AS stage,
  CASE z % 10 WHEN 6 THEN round(0.5 * 1 - 0.3 * (1.33 - 3.33 + 1), 3) WHEN 7 THEN NULL END AS score FROM w WHERE z % 10 <> 6 AND z % 10 <> 7
UNION ALL SELECT k, CASE WHEN z % 10 = 6 THEN 'fruchtsuess' ELSE 'straff_herb' END, 2, CASE WHEN z % 10 = 6 THEN 0.8::DOUBLE ELSE -0.65::DOUBLE END FROM w WHERE z % 10 IN (6, 7)""")
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A = cols("za")
    kind = Z % 10
    name = _text(A, F.when(kind == 0, " Lieblich").when(kind == 1, " Apothic").otherwise(""))
    sheet = F.when(kind == 2, "Restzucker 7,5 g/l").when(kind == 3, "Restzucker: 1.2 g/l, Gesamtsäure 6.8 g/l").when(kind == 4, "15.5 % vol").otherwise("trocken")
    taste = F.when(kind == 6, F.create_map(F.lit("sweetness"), F.lit(3.0), F.lit("tannin"), F.lit(1.0), F.lit("acidity"), F.lit(3.39), F.lit("count"), F.lit(20.0)))
    baseline = F.when(kind == 7, F.create_map(F.lit("sweetness"), F.lit(1.27), F.lit("tannin"), F.lit(4.33), F.lit("acidity"), F.lit(3.89)))
    got = style.classify(name, sheet, F.when(kind == 5, "Vino d'Italia").otherwise("DOC"), F.when((kind != 5) | (Z % 3 == 0), 2019), F.when(kind == 8, "Bold Red").otherwise(""), taste, baseline, _LISTS)
    return base(spark, sf_dir).select("k", got.alias("g")).select("k", "g.typ", F.when(F.col("g.typ") == "unbekannt", 0).otherwise(F.col("g.stage")).alias("stage"),
                                                               F.round("g.score", 3).alias("score"))


@query("""SELECT p_partkey AS k, CASE p_size % 6 WHEN 0 THEN 'rose' WHEN 1 THEN 'rot' WHEN 2 THEN 'weiss' WHEN 3 THEN 'unbekannt' WHEN 4 THEN 'rot' ELSE 'unbekannt' END AS wine_type, CASE WHEN p_size % 3 = 0 THEN 'young' ELSE '' END AS early FROM part""")
def wine_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A = cols("za")
    name = _text(A, F.element_at(F.array(*map(F.lit, [" Rosato Rosso", " Rosso", " Bianco Merlot", " Rosso Bianco", " Merlot", ""])), (Z % 6 + 1).cast("int")))
    kind = maturity.wine_type(name, {"rot": ["rosso"], "weiss": ["bianco"], "rose": ["rosato"]}, {"rot": ["merlot"], "weiss": ["riesling"]})
    early = maturity.early_drinker(_text(A, F.when(Z % 3 == 0, " Primeur").when(Z % 3 == 1, " Primeur Grand Cru").otherwise("")), {"young": ["primeur"]}, ["grand cru"])
    return base(spark, sf_dir).select("k", kind.alias("wine_type"), early.alias("early"))


@query("""WITH r AS (SELECT p_partkey AS k, p_size AS z, CASE p_size % 3 WHEN 0 THEN 'g' WHEN 1 THEN '*' END AS code, CASE WHEN p_size % 4 = 0 THEN 'm' WHEN p_size % 4 = 1 THEN 'g' ELSE '' END AS win, p_size % 5 = 0 AS early FROM part),
s AS (SELECT *, CASE WHEN early AND code = 'g' THEN '*' ELSE code END AS ready FROM r)
SELECT k, coalesce(nullif(win, ''), ready) AS code, CASE WHEN win <> '' AND win <> ready THEN ready END AS conflict, CASE WHEN win <> '' AND (code IS NULL OR win <> ready) THEN 'window' WHEN coalesce(nullif(win, ''), ready) IS NOT NULL THEN 'table' END AS source FROM s""")
def maturity_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drinking window overrides the table's verdict, which stays as a conflict; what is drunk young is ready."""
    K, Z = cols("kz")
    rows = base(spark, sf_dir).select(K.alias("id"), F.lit("rot").alias("wine_type"), F.lit(2019).alias("vintage"), F.when(Z % 5 == 0, "primeur").otherwise("").alias("early"),
                                      F.when(Z % 4 == 0, 2010).when(Z % 4 == 1, 2030).alias("first"), F.when(Z % 4 == 0, 2012).when(Z % 4 == 1, 2035).alias("last"))
    found = base(spark, sf_dir).select(K.alias("id"), F.when(Z % 3 == 0, "g").when(Z % 3 == 1, "*").alias("code"), F.when(Z % 3 < 2, "R").alias("region"))
    got = maturity.attach_codes(rows, found, F.lit(2025))
    return got.select(F.col("id").alias("k"), "maturity.code", F.regexp_extract(F.regexp_replace("maturity.conflict", "^table: ", ""), r"^\S+", 0).alias("conflict"), "maturity.source")


@query("SELECT p_partkey AS item, coalesce(label, '') AS region_label, lo AS price_from, hi AS price_to FROM part LEFT JOIN (VALUES ('Brand#1', 'One', 10.0::DOUBLE, 20.0::DOUBLE), ('Brand#2', 'Two', 15.0::DOUBLE, 40.0::DOUBLE)) r(b, label, lo, hi) ON b = p_brand")
def region_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("Brand#1", "One", 10.0, 20.0), ("Brand#2", "Two", 15.0, 40.0)], "region string, label string, price_from double, price_to double")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("region"))
    return regions.describe(rows, known).select("item", "region_label", "price_from", "price_to")


# the page

@query("SELECT p_partkey AS item FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'd ri') OR contains(lower(p_name || ' ' || p_brand), 'brand#1')")
def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    find = lambda t: explore.Filters(text=t, text_columns=("p_name", "p_brand")).where(rows)
    return find("D RI").unionByName(find("brand#1")).select(F.col("p_partkey").alias("item")).distinct()


@query("SELECT p_partkey AS item, CASE WHEN contains(p_name, 'ring') THEN 'r' WHEN contains(p_name, 'gear') THEN 'g' ELSE '' END || CASE WHEN contains(p_name, 'red') THEN 'd' ELSE '' END AS flags FROM part")
def grape_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.array_join(explore.grape_flags([F.col("p_name"), F.lit(None).cast("string")], {"r": "ring", "g": "gear", "d": "red"}), "").alias("flags"))


@query(f"""WITH {OFFERS_SQL.strip()}, s AS (SELECT item, seller, min(price) AS price FROM offers GROUP BY 1, 2), b AS (SELECT item, min(price) AS best_price, bool_and(seller % 10 = 0) AS market FROM s GROUP BY 1)
SELECT CASE WHEN market THEN 'marktplatz' ELSE 'handel' END AS world, count(*) AS n, count(CASE WHEN p_size % 3 = 0 THEN 1 END) AS charted FROM b JOIN part ON p_partkey = item GROUP BY 1""")
def charted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product's scores: world by who sells an item, ratings by status alone."""
    return flow.settled(spark, lambda keep: _scores(spark, sf_dir, keep).groupBy("world").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("band_score").isNotNull()).alias("charted")))


def _markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.col("s_suppkey").cast("string").alias("seller"))


def _scores(spark: SparkSession, sf_dir: str, keep: flow.Keep) -> DataFrame:
    return flow.score(keep(_scored_items(spark, sf_dir)), keep, _markets(spark, sf_dir))


def _scored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir).groupBy("item", F.col("seller").cast("string").alias("seller")).agg(F.min("price").alias("price"))
    prices = o.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("seller", "price", F.lit("high").alias("confidence"), F.lit("").alias("url")))).alias("prices"), F.min("price").alias("best_price"))
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    return p.select(F.col("p_partkey").alias("item"), F.when(size % 3 == 0, F.when(size % 2 == 0, "exact").otherwise("wine_level")).otherwise("fuzzy").alias("status"), F.when(size % 4 == 0, "fuzzy").otherwise("exact").alias("confidence"),
                    F.round(3.0 + size / 25.0, 2).alias("rating"), (size * 10).alias("rating_count"), F.col("p_type").alias("style"), F.col("p_brand").alias("region"), F.lit("").alias("kind")).join(prices, "item")


@query(f"""WITH {OFFERS_SQL.strip()}, m AS (SELECT item, min(price) AS price, bool_and(seller % 10 = 0) AS market FROM offers GROUP BY 1),
items AS (SELECT item, p_type AS style, p_brand AS region, '' AS kind, CASE WHEN p_size % 3 = 0 THEN round(3.0::DOUBLE + p_size / 25.0::DOUBLE, 2) END AS rating, p_size * 10 AS rating_count, market AS marketplace, NOT market AS swiss, price FROM m JOIN part ON p_partkey = item),{EFFECTIVE_SQL},{score_sql('1')}
SELECT item, round(value_score, 3) + 0.0 AS value_score_all FROM scored WHERE value_score IS NOT NULL""")
def flow_value_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flow's value scores over all worlds, which compare within style and region."""
    return flow.settled(spark, lambda keep: _scores(spark, sf_dir, keep).where("value_score_all IS NOT NULL").select("item", (F.col("value_score_all") + 0.0).alias("value_score_all")))


@query("SELECT item, world, row_number() OVER (PARTITION BY world ORDER BY band, v DESC NULLS LAST, price NULLS LAST, item) AS position FROM (SELECT p_partkey AS item, CASE WHEN p_size % 2 = 0 THEN 'handel' ELSE 'marktplatz' END AS world, p_size % 5 AS band, CASE WHEN p_size % 3 > 0 THEN p_size % 7 END AS v, p_retailprice AS price FROM part)")
def full_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.when(size % 2 == 0, "handel").otherwise("marktplatz").alias("world"), F.element_at(F.array(*(F.lit(b) for b, _, _ in P.BANDS)), (size % 5 + 1).cast("int")).alias("band"),
                                               F.when(size % 3 > 0, (size % 7).cast("double")).alias("value_score"), F.col("p_retailprice").alias("best_price"))
    return flow.full_list(rows).select("item", "world", "position")


# runs and caches

@query("SELECT k, max(v) AS v FROM (SELECT o_custkey AS k, 'old' AS v FROM orders WHERE year(o_orderdate) = 1996 UNION ALL SELECT o_custkey, 'new' FROM orders WHERE year(o_orderdate) = 1997 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)) GROUP BY 1")
def import_without_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    side = lambda year, v: o.where(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("k"), F.lit(v).alias("v")).distinct()
    return snapshots.import_missing(side(1996, "old"), side(1997, "new"), ["k"])


@query("SELECT (SELECT count(*) FROM events) AS ratings, (SELECT count(*) FROM orders) AS offers, (SELECT max(o_orderdate) FROM orders) AS youngest_offer")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.cache_stats(table(spark, sf_dir, "events"), table(spark, sf_dir, "orders").withColumn("fetched_at", F.col("o_orderdate")))


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS seller FROM lineitem WHERE l_returnflag = 'A'")
def sellers_of_a_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source_key"), F.to_json(F.struct(F.col("l_suppkey").alias("retailer"))).alias("payload"))
    return snapshots.sellers_of(rows, "A")


@query("""WITH r AS (SELECT s_suppkey AS source, CASE WHEN s_suppkey % 3 = 0 THEN 'ok' ELSE 'blocked' END AS status, s_suppkey % 2 AS offers FROM supplier), good AS (SELECT source FROM r WHERE status = 'ok' AND offers > 0)
SELECT l_suppkey AS source, 'old' AS run, count(*) AS n FROM lineitem WHERE year(l_shipdate) < 1997 AND l_suppkey NOT IN (SELECT source FROM good) GROUP BY 1 UNION ALL SELECT l_suppkey, 'new', count(*) FROM lineitem WHERE year(l_shipdate) >= 1997 AND l_suppkey IN (SELECT source FROM good) GROUP BY 1""")
def replaced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    reports = table(spark, sf_dir, "supplier").select(s.alias("source"), F.when(s % 3 == 0, "ok").otherwise("blocked").alias("status"), (s % 2).alias("offers"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.when(F.year("l_shipdate") < 1997, "old").otherwise("new").alias("run"))
    return snapshots.replace_source(rows.where("run = 'old'"), rows.where("run = 'new'"), reports).groupBy("source", "run").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id AS id FROM events WHERE CAST(ts AS DATE) < (SELECT max(CAST(ts AS DATE)) FROM events) ORDER BY event_id DESC LIMIT 1")
def previous_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"))
    last = e.agg(F.max(F.to_date("started_at"))).first()[0]
    return snapshots.previous_run(e, F.lit(last)).select("id")


@query("SELECT event_id FROM events WHERE NOT (event_type IN ('click', 'view') AND event_id % 3 = 0) AND NOT event_id % 7 = 0")
def invalidated_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits whose payload lacks a field go, misses stay; so do those of one confidence."""
    kind = F.col("event_type")
    payload = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("taste"), F.when(F.col("event_id") % 7 == 0, "fuzzy").otherwise("exact").alias("match_confidence")))
    rows = table(spark, sf_dir, "events").select("event_id", F.when(kind == "click", "exact").when(kind == "view", "fuzzy").otherwise("no_entry").alias("status"), payload.alias("payload"))
    return snapshots.drop_confidence(snapshots.drop_without_field(rows, "$.taste"), "fuzzy").select("event_id")


@query("""WITH g AS (SELECT o_orderkey AS k, 100 + o_orderkey % 30 AS new_rows, 120 AS old_rows, o_orderkey % 3 = 0 AS older, o_orderkey % 5 = 0 AS stale FROM orders) SELECT k, CASE WHEN older THEN 'later run' WHEN new_rows < 0.9 * old_rows THEN 'fewer rows' ELSE 'ok' END AS page, CASE WHEN stale THEN 'stale' ELSE 'ok' END AS ratings FROM g""")
def page_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    page = snapshots.page_verdict(100 + key % 30, F.lit(120), F.when(key % 3 == 0, "2026-01-01").otherwise("2026-02-01"), F.lit("2026-01-15"))
    fresh = snapshots.fresh_verdict(F.when(key % 5 == 0, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate")), F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(key.alias("k"), page.alias("page"), fresh.alias("ratings"))


@query(f"""WITH {OFFERS_SQL.strip()}, s AS (SELECT CAST(seller AS VARCHAR) AS source, 'item ' || item AS name, price, confidence, epoch(shipped)::BIGINT AS position FROM offers),
g AS (SELECT source, name, list({{'o': position, 'p': price, 'c': CASE confidence WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'low' END}} ORDER BY position, price, confidence) AS rows FROM s GROUP BY 1, 2),
k AS (SELECT source, name, list_reduce(rows, lambda x, y: CASE WHEN (x.c = 'low' AND y.c <> 'low') OR coalesce(nullif(y.p, 0), 9e9) < coalesce(nullif(x.p, 0), 9e9) THEN y ELSE x END) AS r FROM g)
SELECT source, name, r.p AS price, r.c AS confidence, r.o AS position FROM k""")
def dedupe_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offers(spark, sf_dir).select(F.col("seller").cast("string").alias("source"), F.concat(F.lit("item "), F.col("item")).alias("name"), F.lit(None).cast("int").alias("vintage"), "price", "confidence", F.unix_timestamp(F.col("shipped").cast("timestamp")).alias("position"))
    return merge.dedupe_offers(o).drop("vintage")


# outputs

@query("SELECT p_partkey AS item, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'no_entry: no entry matches' ELSE 'ambiguous: ' || p_name END AS reason FROM part")
def missing_rating_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 3
    reason = flow.no_rating_reason(F.when(size == 0, "exact").when(size == 1, "no_entry").otherwise("ambiguous"), F.when(size == 1, "no entry matches").otherwise(F.col("p_name")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), reason.alias("reason"))


@query("""WITH m AS (SELECT p_partkey AS item, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 7.5 WHEN 1 THEN 3.75 WHEN 2 THEN 1.5 ELSE 1 END::DOUBLE, 2) AS bottle FROM part)
SELECT item, bottle, round(bottle / 19.9, 2) AS factor, CASE WHEN round(bottle / 19.9, 2) < 1.5 THEN 'another wine' WHEN round(bottle / 19.9, 2) < 2.5 THEN 'fair' WHEN round(bottle / 19.9, 2) < 4 THEN 'usual' ELSE 'dear' END AS verdict FROM m""")
def restaurant_markups(spark: SparkSession, sf_dir: str) -> DataFrame:
    dl = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(5), F.lit(75)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), ladder.markup(F.col("p_size").cast("double"), dl, F.lit(19.9)).alias("m"))
    return rows.select("item", "m.bottle", "m.factor", "m.verdict")


@query(f"""WITH {OFFERS_SQL.strip()}, s AS (SELECT item, seller, min(price) AS price FROM offers WHERE seller < 3 GROUP BY 1, 2)
SELECT p_name AS name, coalesce(regexp_replace(printf('%.2f', min(price)), '\\.?0+$', ''), '') AS best_price, {', '.join(f"coalesce(regexp_replace(printf('%.2f', min(CASE WHEN seller = {i} THEN price END)), '\\.?0+$', ''), '') AS price_{i}" for i in range(3))}, count(*) AS n FROM s JOIN part ON p_partkey = item GROUP BY item, p_name""")
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's flat table: numbers as texts, one price column per seller."""
    o = offers(spark, sf_dir).where("seller < 3").groupBy("item", F.col("seller").cast("string").alias("seller")).agg(F.min("price").alias("price"))
    items = o.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("seller", "price"))).alias("prices"), F.min("price").alias("best_price"))
    named = items.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name")), "item")
    n = F.lit(0)
    for i in range(3):
        n = n + (F.col(f"price_{i}") != "").cast("int")
    return flow.flat(named, ["0", "1", "2"]).withColumn("n", n)


@query("WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part) SELECT k, CASE WHEN z % 3 = 0 THEN 'unsure' ELSE 'sure' END AS how FROM p WHERE z % 5 <> 0")
def sure_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    Z, A = cols("za")
    rows = base(spark, sf_dir).where("z % 5 <> 0").select("k", A.alias("name"), F.when(Z % 3 != 0, 5.0).alias("price"), F.lit("high").alias("confidence"))
    sure, unsure = leaflet.split_sure(rows)
    return sure.select("k", F.lit("sure").alias("how")).unionByName(unsure.select("k", F.lit("unsure").alias("how")))


@query(ALL_SQL + " SELECT item, rating, row_number() OVER (ORDER BY rating DESC, item) AS position FROM items WHERE rating IS NOT NULL AND price < 0")
def empty_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing in a filter gives no rows and fails nowhere."""
    rows = scores.band_score(T.items(spark, sf_dir).where("price < 0").withColumn("band", F.lit("none")))
    return explore.top_per_group(rows, "band", [F.col("rating").desc(), F.col("item").asc()], 4).select("item", "rating", F.col("position").cast("long").alias("position"))


@query(f"""WITH {BASE_SQL} SELECT CAST(k AS VARCHAR) AS item, CASE WHEN k % 7 IN (0, 1, 4, 5) THEN CASE k % 7 WHEN 0 THEN CASE WHEN z % 2 = 0 THEN 'exact' ELSE 'wine_level' END WHEN 1 THEN 'wine_level' WHEN 4 THEN 'winery_level' ELSE 'too_few_ratings' END ELSE 'no_entry' END AS status,
  CASE k % 7 WHEN 0 THEN CASE WHEN z % 2 = 0 THEN 4.1::DOUBLE ELSE 3.5 END WHEN 1 THEN 3.5 WHEN 4 THEN 3.5 END AS rating, z + 4.5::DOUBLE AS best_price FROM w""")
def whole_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers to rated items: merged, linked through the ladder, claims settled."""
    K, = cols("k")
    shop, catalog = _catalog(spark, sf_dir)
    z = base(spark, sf_dir).select(K.cast("string").alias("shop_id"), "z")
    o = shop.join(z, "shop_id").select(F.col("shop_id").alias("dedup_key"), "name", X.normalized_name(F.col("name")).alias("normalized_name"), F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("seller"), (F.col("z") + 4.5).alias("price"), F.lit("high").alias("confidence"), F.lit("u").alias("url"), "vintage", F.lit(False).alias("private_label"))
    return flow.settled(spark, lambda keep: flow.rate(o, catalog.withColumnRenamed("vintage", "_v"), keep=keep).items.select("item", "status", "rating", "best_price"))


@query(f"""WITH {BASE_SQL}, c AS (SELECT k, a, b, z, k % 3 AS g, CASE z % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS conf FROM w), r AS (SELECT k, row_number() OVER (PARTITION BY z ORDER BY conf DESC, CASE WHEN g = 0 THEN 2 WHEN g = 1 THEN 0 ELSE -1 END DESC, CASE WHEN g = 0 THEN 0 WHEN g = 1 THEN 1 ELSE 1 END, k) AS r, count(*) OVER (PARTITION BY z) AS n FROM c)
SELECT k AS item, CASE WHEN r = 1 OR n = 1 THEN 'kept' ELSE 'lost' END AS claim FROM r""")
def claims_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of one rating: after the confidence, the words that a name shares with what was found decide, then the words it adds."""
    K, Z, A = cols("kza")
    g = K % 3
    rows = base(spark, sf_dir).select(
        K.alias("item"), A.alias("name"), Z.alias("entity"), F.when(g == 0, F.array(F.lit("rocca"), F.lit("guardia"), F.lit("rosso"))).when(g == 1, F.array(F.lit("rocca"), A)).otherwise(F.array(A)).alias("tokens"),
        F.when(g == 0, F.array(F.lit("rocca"), F.lit("guardia"))).when(g == 1, F.array(F.lit("rocca"), A)).otherwise(F.array(A)).alias("distinctive"), F.array(F.lit("rocca"), F.lit("guardia"), F.lit("rosso")).alias("found_tokens"),
        F.array(F.lit("rocca"), F.lit("guardia")).alias("found_distinctive"), F.when(Z % 3 == 0, "exact").when(Z % 3 == 1, "wine_level").otherwise("fuzzy").alias("confidence"), F.lit(4.0).alias("rating"))
    return resolve.shared_claims(rows).select("item", "claim")
