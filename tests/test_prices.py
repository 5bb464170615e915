import pytest
from pyspark.sql import functions as F

from offerlens.functions import prices as P


def one(spark, amount, text, **options):
    df = spark.createDataFrame([(amount, text)], "a double, t string")
    return df.select(P.normalize_price(F.col("a"), F.col("t"), **options).alias("p")).first()["p"]


@pytest.mark.parametrize(("amount", "text", "options", "price", "confidence", "units", "ml"), [
    (41.70, "Karton 6 × 75 cl, exkl. MwSt", {"price_basis": "pack"}, 7.51, "high", 6, 750),
    (41.70, "Karton 6 × 75 cl, exkl. MwSt", {}, 7.51, "high", 6, 750),
    (9.95, "75 cl, inkl. MwSt", {}, 9.95, "high", None, 750),
    (10.0, "50 cl, inkl. MwSt", {}, 15.0, "medium", None, 500),
    (30.0, "Magnum 150 cl, inkl. MwSt", {}, 15.0, "medium", None, 1500),
    (19.9, "Bag-in-Box 3 l, inkl. MwSt", {}, 4.98, "medium", None, 3000),
    (41.7, "Karton, exkl. MwSt", {}, 45.08, "low", None, None),
    (19.9, "Bag-in-Box, exkl. MwSt", {}, 21.51, "low", None, None),
    (108.0, "Karton 12 × 75 cl exkl. MwSt", {"price_basis": "pack"}, 9.73, "high", 12, 750),
    (6.95, "6er Karton, Preis pro Flasche, exkl. MwSt", {}, 7.51, "medium", 6, 750),
    (6.95, "6 × 75 cl", {"price_basis": "bottle", "default_vat_included": False}, 7.51, "high", 6, 750),
    (12.0, "Cabernet 75 cl", {}, 12.0, "high", None, 750),
    (12.0, "Brut Demi-Sec 75 cl", {}, 12.0, "high", None, 750),
    (5.0, "Demi", {}, 10.0, "medium", None, 375),
    (9.0, "Italien, 75 cl, 2024 (100 ml = -.62)", {}, 9.0, "high", None, 750),
    (115.0, "Geschenkkarton 2021", {}, 115.0, "low", None, None),
])
def test_normalize(spark, amount, text, options, price, confidence, units, ml):
    p = one(spark, amount, text, **options)
    assert (p["price"], p["confidence"], p["units"], p["bottle_ml"]) == (pytest.approx(price, abs=0.011), confidence, units, ml)


def test_no_amount_is_no_price(spark):
    p = one(spark, None, "Karton 6")
    assert p["price"] is None
    assert p["confidence"] == "low"


def test_bands_and_discounts(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (9.99,), (10.0,), (80.0,), (-1.0,)], "p double").select(P.price_band(F.col("p")).alias("b")).collect()
    assert [r["b"] for r in rows] == ["", "<10", "<10", "10-20", ">80", ">80"]
    rows = spark.createDataFrame([(5.0, 10.0, True), (5.0, 10.0, False), (10.0, 10.0, True), (None, 1.0, True)], "p double, r double, own boolean")
    d = P.discount_percent(F.col("p"), F.col("r"))
    assert [tuple(r) for r in rows.select(d, P.rate_discount(d, F.col("own"))).collect()] == [(50.0, "questionable"), (50.0, "ok"), (None, "unknown"), (None, "unknown")]


@pytest.mark.parametrize(("price", "raw", "units", "ml", "vat", "pack", "total"), [
    (9.95, 59.70, 6, 750, False, False, 59.70),
    (9.95, 9.95, 6, 750, False, True, 59.70),
    (7.51, 41.70, 6, 750, True, True, 45.08),
    (15.0, 10.0, 1, 500, False, False, 10.0),
    (None, 10.0, 6, None, False, False, 60.0),
    (None, 10.0, 6, None, False, True, 10.0),
])
def test_payable_total(spark, price, raw, units, ml, vat, pack, total):
    df = spark.createDataFrame([(price, raw, units, ml, vat, pack)], "p double, r double, u int, m int, v boolean, k boolean")
    assert df.select(P.payable_total(*(F.col(c) for c in "prumvk"))).first()[0] == pytest.approx(total, abs=0.03)


def test_independent_price_skips_own_hosts_and_prefers_home(spark):
    df = spark.sql("""SELECT array(named_struct('per_75cl', 9D, 'url', 'https://www.own.ch/x'), named_struct('per_75cl', 10D, 'url', 'https://far.com/x'),
        named_struct('per_75cl', 12D, 'url', 'https://home.ch/x')) AS p, array('own.ch') AS own""")
    got = df.select(P.independent_price(F.col("p"), F.col("own")).alias("m")).first()["m"]
    assert tuple(got) == (12.0, "home.ch", False)
    assert df.select(P.independent_price(F.col("p"), F.array(F.lit("own.ch"), F.lit("home.ch"))).alias("m")).first()["m"]["foreign"]
