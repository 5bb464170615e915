import json

import pytest
from pyspark.sql import functions as F

from offerlens.operators import ladder, matching
from offerlens.sources import ratings


def hit(wine, name, year, avg=None, n=0, wavg=4.0, wn=100, type_id=1, prices=()):
    return {"vintage": {"id": 1, "name": name, "year": year, "wine": {"id": wine, "name": name, "type_id": type_id, "seo_name": "slug", "winery": {"name": "Haus", "seo_name": "haus"},
            "taste": {"structure": {"sweetness": 2.0, "tannin": 0, "acidity": None, "user_structure_count": 30}}},
            "statistics": {"ratings_average": avg, "ratings_count": n, "wine_ratings_average": wavg, "wine_ratings_count": wn}}, "prices": list(prices)}


def payloads(spark, *matches):
    return spark.createDataFrame([(json.dumps({"explore_vintage": {"matches": list(matches)}}),)], "payload string")


def test_entries(spark):
    price = {"amount": 60.0, "currency": {"code": "CHF"}, "bottle_quantity": 6, "bottle_type": {"volume_ml": 750}, "url": "https://a.ch/x"}
    rows = ratings.entries(payloads(spark, hit(7, "A", "2020", 4.1, 9, prices=[price, price | {"currency": {"code": "EUR"}}]), hit(7, "A", "2020"), hit(7, "A", "N.V."), hit(None, "B", ""))).collect()
    assert sorted((r["entry_id"], r["rated"]) for r in rows) == [("7|", False), ("7|2020", True)]
    r = next(r for r in rows if r["year"] == 2020)
    assert r["taste"] == {"sweetness": 2.0, "count": 30.0}
    assert [p["per_75cl"] for p in r["prices"]] == [10.0]
    assert r["url"].endswith("/w/7")


def test_contract(spark):
    ratings.check_contract(payloads(spark, hit(7, "A", "2020")))
    ratings.check_contract(spark.createDataFrame([("{}",)], "payload string"))
    for bad in ('{"other": 1}', '{"explore_vintage": {"matches": 3}}', '{"explore_vintage": {"matches": [{"vintage": {}}]}}'):
        with pytest.raises(ratings.BrokenContract):
            ratings.check_contract(spark.createDataFrame([(bad,)], "payload string"))


def test_windows_and_points(spark):
    df = spark.createDataFrame([('{"drinking_window":{"start_year":2020,"end_year":null}}', "Falstaff: 93 Punkte"), ("", "49 Punkte"), (None, None)], "h string, t string")
    got = [(tuple(r[0]), r[1]) for r in df.select(ratings.drinking_window(F.col("h")), ratings.critic_points(F.col("t"))).collect()]
    assert got == [((2020, None), 93.0), ((None, None), None), ((None, None), None)]


@pytest.mark.parametrize(("name", "type_id", "conflict"), [("Vermentino San Felice", 1, True), ("Merlot X", 1, False), ("La Vermentino X", 1, False), ("San Felice", 1, False), ("Merlot", None, False)])
def test_colour_conflict(spark, name, type_id, conflict):
    df = spark.createDataFrame([(name, type_id)], "n string, t int")
    assert df.select(ladder.colour_conflict(F.col("n"), F.col("t"))).first()[0] is conflict


def test_one_name_in_two_colours_is_undecidable(spark):
    rows = [("s", "Whispering Angel", "a", "Whispering Angel Rosé", 4), ("s", "Whispering Angel", "b", "Whispering Angel Rouge", 1), ("t", "Whispering Angel Rosé", "a", "Whispering Angel Rosé", 4), ("t", "Whispering Angel Rosé", "b", "Whispering Angel Rouge", 1),
            ("u", "Campo", "c", "Campo", 1), ("u", "Campo", "d", "Campo Rosé", 4)]
    df = spark.createDataFrame(rows, "shop_id string, shop_name string, entry_id string, entry_name string, type_id int")
    assert {tuple(r) for r in ladder.undecidable(df).collect()} == {("s", "a"), ("s", "b")}


def test_ladder(spark, tmp_path):
    shop = spark.createDataFrame([("s1", "Rossetti Linda Bolgheri", 2022), ("s2", "Rossetti Linda Bolgheri", 2019), ("s3", "Unbekannter Tropfen", None), ("s4", "Farnese Montepulciano Casale", None)], "shop_id string, name string, vintage int")
    catalog = spark.createDataFrame([("e1", "Rossetti Linda Bolgheri", 2022, True, 4.3, 50, 4.1, 900, "u1"), ("e2", "Farnese Montepulciano Casale", None, False, None, 2, None, 2, "u2")],
                                    "entry_id string, name string, vintage int, rated boolean, vintage_avg double, vintage_count int, wine_avg double, wine_count int, url string").withColumn("year", F.col("vintage"))
    ranked = matching.rank(matching.link(shop, catalog))
    got = {r["shop_id"]: r for r in ladder.settle(ranked, catalog, shop).collect()}
    assert [(got[k]["status"], got[k]["rating"]) for k in ("s1", "s2", "s3", "s4")] == [("exact", 4.3), ("wine_level", 4.1), ("no_entry", None), ("too_few_ratings", None)]
    assert all(r["url"] for r in got.values())
    both = spark.createDataFrame([("s1", "fuzzy", "exact", 1), ("s1", "exact", "wine_level", 2)], "shop_id string, confidence string, status string, query_no int")
    assert ladder.best_of(both).first()["query_no"] == 2


def test_markup(spark):
    df = spark.createDataFrame([(8.0, 1, 20.0), (25.0, None, 20.0)], "p double, g int, s double")
    assert [tuple(r[0]) for r in df.select(ladder.markup(F.col("p"), F.col("g"), F.col("s"))).collect()] == [(60.0, 3.0, "usual"), (25.0, 1.25, "another wine")]
