import math
import statistics

import pytest
from pyspark.sql import functions as F

from offerlens.operators import explore, maturity, merge, regions, resolve, scores, snapshots, style


def plain_scores(rows):
    """The hierarchical score in a few lines of Python, one pool."""
    steps = [round(r["rating"], 1) for r in rows]
    n = len(steps)
    rare = {s: -math.log10(sum(x >= s for x in steps) / n) for s in set(steps)}
    raw = [rare[s] for s in steps]
    k = statistics.pstdev(steps) / statistics.pstdev(raw)
    eff = [0.5 * r["rating"] + 0.5 * (statistics.mean(steps) + (rare[s] - statistics.mean(raw)) * k) for r, s in zip(rows, steps)]
    xs = [math.log10(r["price"]) for r in rows]
    my, mx = statistics.mean(eff), statistics.mean(xs)
    return {r["item"]: (e - (my + 0.7 * (x - mx))) * r["rating_count"] / (r["rating_count"] + 50) for r, e, x in zip(rows, eff, xs)}


def test_value_score_is_the_formula(spark):
    rows = [{"item": i, "rating": 3.5 + (i * 7 % 12) / 10, "price": 5.0 + i * 3, "rating_count": 10 * i + 1, "kind": "", "style": "", "region": ""} for i in range(20)]
    df = spark.createDataFrame(rows, "item int, rating double, price double, rating_count int, kind string, style string, region string")
    got = {r["item"]: r["value_score"] for r in scores.value_scores(scores.effective_rating(df), None).collect()}
    want = plain_scores(rows)
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_equal_ratings_have_mean_zero(spark):
    df = spark.createDataFrame([(i, 4.0, 10.0 + i, 100, "", "", "") for i in range(20)], "item int, rating double, price double, rating_count int, kind string, style string, region string")
    out = scores.value_scores(scores.effective_rating(df), None).agg(F.avg("value_score")).first()[0]
    assert abs(out) < 1e-9


def test_thin_groups_fall_back_and_flat_prices_keep_the_coarser(spark):
    rows = [(i, 3.5 + i % 5 / 10, 10.0 + i, 100, "weich", "a" if i < 5 else "b", "r") for i in range(17)]
    df = spark.createDataFrame(rows, "item int, rating double, price double, rating_count int, kind string, style string, region string")
    got = {r["style"]: r["ref_level"] for r in scores.value_scores(df.withColumn("effective", F.col("rating")), None).select("style", "ref_level").distinct().collect()}
    assert got == {"a": "pool", "b": "region"}
    flat = df.withColumn("price", F.lit(10.0)).withColumn("effective", F.col("rating"))
    assert scores.value_scores(flat, None).where("value_score IS NOT NULL").count() == 0


OFFER = "source string, name string, vintage int, price double, confidence string, position int"


def test_dedupe_keeps_the_cheaper_even_if_low_but_drops_a_low_incumbent(spark):
    rows = [("s", "A", None, 5.0, "low", 1), ("s", "a ", None, 9.0, "high", 2), ("s", "B", None, 9.0, "high", 1), ("s", "B", None, 5.0, "low", 2), ("s", "B", 2020, 1.0, "high", 3)]
    got = {(r["name"].strip().lower(), r["vintage"]): (r["price"], r["confidence"]) for r in merge.dedupe_offers(spark.createDataFrame(rows, OFFER)).collect()}
    assert got == {("a", None): (9.0, "high"), ("b", None): (5.0, "low"), ("b", 2020): (1.0, "high")}


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_dedupe_is_the_fold_in_order(spark, batch):
    """Against the rule in plain Python, over products that lie across batches."""
    import random

    rng = random.Random(3)
    rows = [("s", f"n{rng.randint(0, 5)}", rng.choice([None, 2020]), rng.choice([None, 0.0, *map(float, range(1, 9))]), rng.choice(["low", "medium", "high"]), i) for i in range(200)]
    want = {}
    for source, name, vintage, price, confidence, position in rows:
        cost, old = price or 9e9, want.get((source, name, vintage))
        if old is None or (old[1] == "low" and confidence != "low") or cost < (old[0] or 9e9):
            want[source, name, vintage] = (price, confidence, position)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rng.shuffle(rows)
        got = {(r["source"], r["name"], r["vintage"]): (r["price"], r["confidence"], r["position"]) for r in merge.dedupe_offers(spark.createDataFrame(rows, OFFER).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want
    assert merge.dedupe_offers(spark.createDataFrame([], OFFER)).count() == 0


def test_the_diff_names_every_change(spark):
    from offerlens.plans import flow

    diff = spark.sql("SELECT concat('k', id) AS key, CAST(NULL AS DOUBLE) AS delta, 'gone' AS change FROM range(600) UNION ALL SELECT 'p', -1.5D, 'price'")
    text = flow.diff_markdown(diff)
    assert text.count("- k") == 600 and "- p: -1.50" in text


def test_merge_two_sellers(spark):
    rows = [("k", "Tenute Rossetti Linda", "rossetti linda", "coop", 12.95, "high", "u1", 2022, False), ("k", "Rossetti", "rossetti", "prodega", 9.73, "high", "u2", 2022, True),
            ("k", "Rossetti", "rossetti", "prodega", 1.20, "low", "u3", 2022, False)]
    df = spark.createDataFrame(rows, "dedup_key string, name string, normalized_name string, seller string, price double, confidence string, url string, vintage int, private_label boolean")
    m = merge.merge_offers(df)
    r = m.select("name", "private_label", merge.best_price(F.col("prices")), merge.cheapest_seller(F.col("prices")), merge.seller_count(F.col("prices")), merge.spread(F.col("prices"))).first()
    assert tuple(r) == ("Tenute Rossetti Linda", True, 9.73, "prodega", 2, 3.22)


def test_only_unsure_prices_give_no_best(spark):
    df = spark.sql("SELECT array(named_struct('seller', 'a', 'price', 1.2D, 'confidence', 'low')) AS p")
    assert tuple(df.select(merge.best_price(F.col("p")), merge.cheapest_seller(F.col("p")), merge.spread(F.col("p"))).first()) == (None, "", None)


def test_shared_claims(spark):
    row = lambda i, t, c: (i, i, t, t, ["rocca"], ["rocca"], c, 4.2, "e")
    df = spark.createDataFrame([row("a", ["rocca", "guardia"], "fuzzy"), row("b", ["rocca"], "exact")], "item string, name string, tokens array<string>, distinctive array<string>, found_tokens array<string>, found_distinctive array<string>, confidence string, rating double, entity string")
    got = {r["item"]: (r["claim"], r["rating"], r["winner"]) for r in resolve.shared_claims(df).collect()}
    assert got == {"a": ("lost", None, "b"), "b": ("kept", 4.2, "b")}
    same = df.withColumn("tokens", F.array(F.lit("rocca")))
    assert resolve.shared_claims(same).where("claim = 'kept'").count() == 2


def test_diff_and_gates(spark):
    old = spark.createDataFrame([("a", 10.0, 4.0, "x"), ("b", 5.0, None, "x"), ("c", 1.0, 1.0, "x"), ("e", 1.0, 1.0, "x")], "key string, price double, rating double, status string")
    new = spark.createDataFrame([("a", 10.05, 4.0, "x"), ("b", 5.04, 3.0, "x"), ("d", 1.0, 1.0, "x"), ("e", 1.0, 1.0, "y")], "key string, price double, rating double, status string")
    got = {r["key"]: r["change"] for r in snapshots.snapshot_diff(old, new).collect()}
    assert got == {"a": "price", "b": "rated", "c": "gone", "d": "new", "e": "status"}
    snapshots.check(new, 4)
    with pytest.raises(snapshots.Implausible):
        snapshots.check(new.withColumn("status", F.lit("blocked")), 4)
    with pytest.raises(snapshots.Implausible):
        snapshots.check(new, 100)
    with pytest.raises(snapshots.Implausible):
        snapshots.check(new.limit(0), None)
    with pytest.raises(snapshots.Implausible):
        snapshots.check_page(80, 100, "2", "1")
    snapshots.check_page(80, 100, "2", "1", force=True)
    assert not any(r["is_new"] for r in snapshots.new_flags(new, old.limit(1), "key").collect())


def test_cache_rules(spark):
    rows = spark.sql("""SELECT * FROM VALUES ('exact', 89, NULL, true), ('exact', 91, NULL, false), ('no_entry', 31, NULL, false), ('no_entry', 29, NULL, true),
        ('blocked', 2, 5, true), ('blocked', 8, 5, false), ('blocked', 2, -1, false), ('blocked', 2, NULL, false), ('error', 0, NULL, false) AS t(status, age, retry, want)""")
    now = F.to_timestamp(F.lit("2026-01-31"))
    fetched = F.timestamp_seconds(F.unix_timestamp(now) - F.col("age") * 86400)
    retry = F.timestamp_seconds(F.unix_timestamp(now) + F.col("retry") * 86400)
    assert all(r[0] == r[1] for r in rows.select(snapshots.rating_valid(F.col("status"), fetched, retry, now), "want").collect())


def test_replace_only_sources_that_answered(spark):
    o = spark.createDataFrame([("a", 1), ("b", 1)], "source string, v int")
    n = spark.createDataFrame([("a", 2)], "source string, v int")
    reports = spark.createDataFrame([("a", "ok", 1), ("b", "empty", 0)], "source string, status string, offers int")
    assert sorted(map(tuple, snapshots.replace_source(o, n, reports).collect())) == [("a", 2), ("b", 1)]
    assert sorted(map(tuple, snapshots.import_missing(o, n.unionByName(spark.createDataFrame([("c", 3)], "source string, v int")), ["source"]).collect())) == [("a", 1), ("b", 1), ("c", 3)]
    assert sorted(map(tuple, snapshots.upsert(o, n, ["source"]).collect())) == [("a", 2), ("b", 1)]


def test_facets_ignore_their_own_filter(spark):
    df = spark.createDataFrame([(1, "rot", "x", 4.5), (2, "weiss", "x", 4.5), (3, "rot", "y", 4.5), (4, None, "x", 4.5), (5, "rot", "x", 3.0)], "id int, kind string, shop string, rating double")
    f = explore.Filters(choices={"kind": ["rot"], "shop": ["x"]}, min_rating=4.2)
    got = {(r["facet"], r["value"]): r["n"] for r in explore.facet_counts(df, f, ["kind", "shop"]).collect()}
    assert got == {("kind", "rot"): 1, ("kind", "weiss"): 1, ("kind", "?"): 1, ("shop", "x"): 1, ("shop", "y"): 1}
    assert [r["id"] for r in f.where(df).collect()] == [1]


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 1.0)], "id int, v double")
    assert [r["id"] for r in explore.sort_rows(df, "v").collect()] == [3, 2, 1]
    assert [r["id"] for r in explore.sort_rows(df, "v", True).collect()] == [2, 3, 1]


def test_longest_alias(spark):
    aliases = spark.createDataFrame([("chianti", "toscana"), ("chianti classico", "cc"), ("barolo", "barolo")], "alias string, region string")
    rows = spark.createDataFrame([("Chianti Classico Riserva",), ("Chianti",), ("Nirgends",)], "region_name string")
    got = {r["region_name"]: r["region"] for r in regions.assign(rows, aliases).collect()}
    assert got == {"Chianti Classico Riserva": "cc", "Chianti": "toscana", "Nirgends": None}


def test_windows_and_maturity(spark):
    rows = spark.sql("SELECT * FROM VALUES (2026, 2030, 'g'), (2010, 2020, 'm'), (2020, 2040, 'k'), (2020, 2026, '*'), (2025, 2025, '*'), (2030, 2020, ''), (NULL, 2020, '') AS t(a, b, want)")
    assert all(r[0] == r[1] for r in rows.select(maturity.window_code(F.col("a"), F.col("b"), F.lit(2025)), "want").collect())
    tokens = spark.createDataFrame([("Toskana", "chianti"), ("Chianti Classico", "chianti classico"), ("Barolo", "barolo")], "region string, token string")
    table = spark.createDataFrame([("Toskana", "rot", 2019, "k"), ("Chianti Classico", "rot", 2019, "g"), ("Barolo", "rot", 2019, "g")], "region string, wine_type string, vintage int, code string")
    wines = spark.createDataFrame([(1, "Chianti Classico X", 2019, "rot"), (2, "Chianti X", 2019, "unbekannt"), (3, "Barolosa", 2019, "rot"), (4, "Chianti", 2018, "rot")], "id int, name string, vintage int, wine_type string")
    got = {r["id"]: r["code"] for r in maturity.lookup(wines, tokens, table).collect()}
    assert got == {1: "g", 2: "k", 3: None, 4: None}


@pytest.mark.parametrize(("name", "sheet", "denomination", "vintage", "typ", "stage"), [
    ("Gran Passione Appassimento", None, None, 2020, "fruchtsuess", 1), ("Apothic Red", None, None, 2020, "fruchtsuess", 1), ("X", "Restzucker 7 g/l", None, 2020, "fruchtsuess", 1),
    ("X", "Restzucker 1.2 g/l, Gesamtsäure 6.8 g/l", None, 2020, "straff_herb", 1), ("X", "15.5 % vol", None, 2020, "fruchtsuess", 1),
    ("Tre Autoctoni", None, "Vino d'Italia", None, "fruchtsuess", 1), ("Tre", None, "Vino d'Italia", 2019, "weich_modern", 2), ("X", None, None, 2020, "unbekannt", 0),
])
def test_style_cascade(spark, name, sheet, denomination, vintage, typ, stage):
    lists = style.Lists(["appassimento"], ["apothic"], ["vino d'italia"], {"Puglian Red": "fruchtsuess"})
    df = spark.createDataFrame([(name, sheet, denomination, vintage)], "n string, s string, d string, v int")
    none = F.lit(None).cast("map<string,double>")
    got = df.select(style.classify(F.col("n"), F.col("s"), F.col("d"), F.col("v"), F.lit(None).cast("string"), none, none, lists).alias("c")).first()["c"]
    assert (got["typ"], got["stage"]) == (typ, stage)


def test_a_cache_moves_to_the_known_schema(spark):
    old = spark.createDataFrame([(1, "x")], "id int, vivid string")
    assert snapshots.migrate(old, 1, 3, {2: {"vivid": "payload"}, 3: {"payload": "body"}}).columns == ["id", "body"]
    with pytest.raises(ValueError, match="schema 4"):
        snapshots.migrate(old, 4, 3, {})
