"""Work that must not depend on how small a table looks: no broadcast by estimate, kept steps, names that meet by chance."""

import os

import pytest
from pyspark.sql import functions as F

from offerlens.functions import prices as P
from offerlens.operators import maturity
from offerlens.plans import flow, queries, record_queries, rule_queries  # noqa: F401  they register their queries
from offerlens.sources import leaflet


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_leaflet_cells_broadcast_no_page(spark):
    words = spark.createDataFrame([(1, "75", 10.0, 320.0), (1, "cl", 30.0, 321.0), (1, "Fendant", 10.0, 420.0)], "page int, text string, x0 double, top double")
    anchors = spark.createDataFrame([(1, "left", 10.0, 400.0)], "page int, anchor string, x0 double, top double")
    got = leaflet.cells(words, anchors)
    assert "Broadcast" not in plan(got)
    assert [(r["above"], r["below"]) for r in got.collect()] == [(["75 cl"], ["Fendant"])]


def test_year_table_broadcasts_no_page(spark):
    glyphs = spark.createDataFrame([(1, "a", 101.0, "g"), (1, "a", 139.0, "k")], "page int, block string, x double, code string")
    columns = spark.createDataFrame([(1, 2018, 100.0), (1, 2019, 140.0), (1, 2020, 180.0)], "page int, year int, x double")
    got = maturity.year_table(glyphs, columns)
    assert "Broadcast" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [("a", 2018, "g"), ("a", 2019, "k"), ("a", 2020, "-")]


def test_settled_keeps_steps_and_session(spark):
    static, counted = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before, seen = spark.conf.getAll, []

    def make(keep):
        a = keep(spark.range(6).withColumn("x", F.col("id") * 2))
        seen.append((a.inputFiles()[0], plan(a.join(keep(spark.range(3)), "id"))))
        return a.join(spark.range(3), "id")

    got = flow.settled(spark, make)
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 2), (2, 4)]
    assert "Broadcast" not in seen[0][1] and "Join" not in plan(got)
    assert not os.path.exists(seen[0][0].removeprefix("file://"))
    assert [spark.conf.getAll.get(k) for k in (static, counted)] == [before.get(k) for k in (static, counted)]


def test_market_places_may_be_a_table_of_thousands(spark):
    one = lambda item, *sellers: (item, [(s, 10.0, "high", "") for s in sellers], 10.0, "exact", "exact", 4.0, 10)
    items = spark.createDataFrame([one(1, "m1"), one(2, "m7000", "s"), one(3, "s"), one(4, "m1", "m7000")],
                                  "item int, prices array<struct<seller:string,price:double,confidence:string,url:string>>, best_price double, status string, confidence string, rating double, rating_count int")
    places = [f"m{i}" for i in range(7001)]
    table = spark.createDataFrame([(p,) for p in places], "seller string")
    want = {1: "marktplatz", 2: "handel", 3: "handel", 4: "marktplatz"}
    assert dict(flow.score(items, marketplaces=table).select("item", "world").collect()) == want
    assert dict(flow.score(items, marketplaces=places).select("item", "world").collect()) == want


@pytest.mark.parametrize("name", ["charted_items", "flow_value_scores"])
def test_more_sellers_than_columns(spark, sf, tmp_path, name):
    for t in ("part", "lineitem"):
        os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.range(60_000).withColumnRenamed("id", "s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    assert queries.QUERIES[name](spark, str(tmp_path)).count() > 0


def test_bargain_ties_round_as_in_sql(spark):
    rows = spark.createDataFrame([(922.86,), (1222.02,), (997.38,)], "p double")
    assert [r[0] for r in rows.select(P.bargain_percent(F.lit(1080.0), F.col("p"), F.lit(True))).collect()] == [14.6, -13.2, 7.7]


def part(spark, tmp_path, rows):
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_cash_and_carry_keeps_items_whose_words_meet(spark, tmp_path):
    got = queries.QUERIES["cash_and_carry"](spark, part(spark, tmp_path, [(144022, 42), (168458, 14)])).collect()
    assert sorted(map(tuple, got))[:2] == [("cagpnjhe", 19.46), ("cagpnjhe", 49.73)] and len(got) == 3


def test_overrides_tell_items_whose_words_meet_apart(spark, tmp_path):
    got = queries.QUERIES["manual_overrides"](spark, part(spark, tmp_path, [(409101, 20), (413880, 23)])).collect()
    assert sorted(map(tuple, got)) == [(409101, 4.9, "https://r.example/409101"), (413880, 2.3, None)]
