import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from offerlens.functions import similarity as S, text as X


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(("name", "tokens"), [
    ("Castelbarco Ripasso della Valpolicella DOC Superiore 2020 75cl", ["castelbarco", "ripasso", "valpolicella", "superiore"]),
    ("Cune (CVNE) Parker 95 Crianza 6x75cl", ["cune", "crianza"]),
    ("Ànima Negra ÀN/2", ["anima", "negra", "an", "2"]),
    (None, []),
    ("", []),
])
def test_tokenize(spark, name, tokens):
    assert col(spark, name, X.tokenize) == tokens


def test_key_ignores_order_and_a_spare_country(spark):
    a, b = (col(spark, n, lambda c: X.dedup_key(c, F.lit(2022))) for n in ("Ribera del Duero DO Protos Roble – Rotwein, Spanien", "Ribera del Duero Roble Protos DO"))
    assert a == b
    a, b = (col(spark, n, lambda c: X.dedup_key(c, F.lit(None))) for n in ("Cabernet Sauvignon, Chile", "Cabernet Sauvignon, Australien"))
    assert a != b


@pytest.mark.parametrize(("text", "year"), [("Rioja 2019 75 cl", 2019), ("750 ml", None), ("1949 2040", None), ("Los 12018 x", None), (None, None)])
def test_vintage(spark, text, year):
    assert col(spark, text, X.extract_vintage) == year


@pytest.mark.parametrize(("name", "style"), [("Rosé Champagne Brut", "champagner"), ("Prosecco", "schaumwein"), ("Sauternes", "suesswein"), ("Bianco di Merlot", "weiss"),
                                             ("Merlot", "rot"), ("Irgendwas", "unbekannt"), ("Chiaretto", "rose")])
def test_style(spark, name, style):
    assert col(spark, name, X.wine_style) == style


@pytest.mark.parametrize(("text", "amount"), [("CHF 1'250.50", 1250.5), ("12,90 statt 15", 12.9), ("-", None), (None, None)])
def test_price_text(spark, text, amount):
    assert col(spark, text, X.parse_price) == amount


def test_critics(spark):
    got = col(spark, "Parker 92/100, James Suckling 95/100, Suckling 97/100, Parker 30/100", lambda c: X.critic_scores(c, {"parker": "parker", "suckling": "suckling"}))
    assert got == {"parker": 92.0, "suckling": 97.0}


@pytest.mark.parametrize(("x", "shown"), [(4.50, "4.5"), (100.0, "100"), (3.14, "3.14")])
def test_numbers(spark, x, shown):
    assert spark.createDataFrame([(x,)], "x double").select(X.format_number(F.col("x"))).first()[0] == shown


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(row[j] + 1 if c == d else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", max_size=30))
def test_similarity_against_the_definition(a, b):
    assert S.lcs(a, b) == slow_lcs(a, b)
    assert S.ratio(a, b) == S.ratio(b, a)
    assert 0 <= S.name_score(a, b) <= 100.0001


def test_subset_scores_full():
    assert S.set_ratio("imperial rioja", "cune imperial rioja reserva") == 100.0
    assert S.set_ratio("", "a") == 0.0


@pytest.mark.parametrize(("name", "shown"), [("Rioja DOCa Crianza Bodegas Izadi (2022) – Rotwein, Spanien (0.75l)", "Rioja DOCa Crianza Bodegas Izadi"), ("Chianti 75 cl", "Chianti"), ("Barolo Magnum", "Barolo Magnum"), (None, "")])
def test_display_name(spark, name, shown):
    assert col(spark, name, X.display_name) == shown


def test_small_formats(spark):
    got = spark.sql("SELECT date'2026-08-05' AS d, 3.61D AS v, 42 AS n").select(X.format_date(F.col("d")), X.rating_text(F.col("v"), 5, F.col("n")), X.rating_text(F.lit(89.0), 100, F.lit(None).cast("int")), X.truncate(F.lit("abcdef"), 4), X.format_chf(F.lit(1250.0))).first()
    assert tuple(got) == ("5.8.2026", "3.6/5 (42)", "89/100", "abc…", "CHF 1'250.00")
