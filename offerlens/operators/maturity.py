"""Drinking maturity from a region table and from drinking windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import any_word, fold
from .small import dealt

# Fixed values.
CODES = ["g", "k", "*", "m", "-"]
STILL_MATURING = ["g", "k"]
MAX_DIMENSION = 50_000


def window_code(first: Column, last: Column, today: Column) -> Column:
    """g before the window, m after it, k in its first half, else ``*``; "" if the window makes no sense."""
    bad = first.isNull() | last.isNull() | (last < first)
    return (F.when(bad, "").when(today < first, "g").when(today > last, "m")
            .when((last > first) & (today < first + (last - first) / 2), "k").otherwise("*"))


def wine_type(name: Column, explicit: dict[str, list[str]], hints: dict[str, list[str]]) -> Column:
    """Rosé words, then stated colours, then grapes; a name that says both colours says none."""
    t = fold(F.coalesce(name, F.lit("")))
    has = lambda words: t.rlike(any_word(words)) if words else F.lit(False)
    r, w, rh, wh = has(explicit.get("rot", [])), has(explicit.get("weiss", [])), has(hints.get("rot", [])), has(hints.get("weiss", []))
    return (F.when(has(explicit.get("rose", [])), "rose").when(r & ~w, "rot").when(w & ~r, "weiss").when(rh & ~wh, "rot").when(wh & ~rh, "weiss").otherwise("unbekannt"))


def early_drinker(name: Column, markers: dict[str, list[str]], exceptions: list[str]) -> Column:
    """Label of a style that is drunk young, unless an exception is named; "" for none."""
    t = fold(F.coalesce(name, F.lit("")))
    named = F.coalesce(*(F.when(t.rlike(any_word(words)), label) for label, words in markers.items()), F.lit(""))
    return F.when(t.rlike(any_word(exceptions)), "").otherwise(named) if exceptions else named


def lookup(rows: DataFrame, tokens: DataFrame, table: DataFrame) -> DataFrame:
    """``code, region`` of ``rows(id, name, vintage, wine_type)``.

    ``tokens(region, token)`` name regions: the longest token that stands as a
    word wins, ties keep all their regions. ``table(region, wine_type, vintage,
    code)`` answers only if all candidates agree. Both are dimensions, checked
    before they are broadcast; the containment test runs on distinct names.
    """
    for dim in (tokens, table):
        if dim.limit(MAX_DIMENSION + 1).count() > MAX_DIMENSION:
            raise ValueError("a maturity table is no dimension")
    word = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("_t"), F.lit(r"\E(?![a-z0-9])"))
    names = rows.select("name").distinct().withColumn("_n", fold(F.col("name")))
    dim = tokens.select(F.col("region").alias("_region"), fold(F.col("token")).alias("_t"))
    hit = names.join(F.broadcast(dim), F.col("_n").contains(F.col("_t")) & F.regexp_like("_n", word))
    best = hit.groupBy("name", "_region").agg(F.max(F.length("_t")).alias("len"))
    best = best.withColumn("r", F.rank().over(Window.partitionBy("name").orderBy(F.desc("len")))).where("r = 1").select("name", "_region")
    found = rows.join(best, "name").join(F.broadcast(table.withColumnsRenamed({"region": "_region", "wine_type": "_wt", "vintage": "_v"})), ["_region"])
    found = found.where((F.col("vintage") == F.col("_v")) & ((F.col("wine_type") == "unbekannt") | (F.col("wine_type") == F.col("_wt"))))
    agreed = found.groupBy("id").agg(F.min("code").alias("lo"), F.max("code").alias("hi"), F.min("_region").alias("region")).where("lo = hi")
    return rows.join(agreed.select("id", F.col("lo").alias("code"), "region"), "id", "left")


def settle(table_code: Column, window: Column, early: Column) -> Column:
    """``struct(code, conflict)``: a drinking window overrides the table, whose other verdict stays as a conflict; what is drunk young is ready."""
    ready = F.when((early != "") & table_code.isin(STILL_MATURING), "*").otherwise(table_code)
    own = F.nullif(window, F.lit(""))
    return F.struct(F.coalesce(own, ready).alias("code"), F.when(own.isNotNull() & (own != ready), ready).alias("conflict"))


def attach_codes(rows: DataFrame, found: DataFrame, today: Column) -> DataFrame:
    """``rows(id, wine_type, vintage, early, first, last)`` with ``maturity``: the table's verdict, overridden by a drinking window.

    ``found`` is ``lookup``'s table. The struct says ``code, conflict, source``, what it rests on
    (``basis``) and both as a sentence (``note``).
    """
    got = rows.join(found.select("id", F.col("code").alias("_code"), F.col("region").alias("_region")), "id", "left")
    window = window_code(F.col("first"), F.col("last"), today)
    both = settle(F.col("_code"), window, F.coalesce("early", F.lit("")))
    by_window = (window != "") & (F.col("_code").isNull() | (window != both["code"]) | both["conflict"].isNotNull())
    source = F.when(by_window, "window").when(F.col("_code").isNotNull(), "table")
    aged = (F.coalesce("early", F.lit("")) != "") & F.col("_code").isin(STILL_MATURING)
    basis = F.when(by_window, F.concat(F.lit("window "), F.concat_ws("-", "first", "last"))).when(aged, F.concat("early", F.lit(" (style before region)"))).otherwise(F.coalesce("_region", F.lit("")))
    named = got.withColumns({"_both": both, "_source": source, "_basis": basis})
    note = F.concat(F.col("_both.code"), F.lit(" ("), F.concat_ws(" ", F.nullif("_basis", F.lit("")), "wine_type"), F.lit(", vintage "), F.coalesce(F.col("vintage").cast("string"), F.lit("?")), F.lit(")"))
    conflict = F.when(F.col("_both.conflict").isNotNull(), F.concat(F.lit("table: "), F.col("_both.conflict"), F.coalesce(F.concat(F.lit(" ("), F.concat_ws(" ", "_region", "wine_type"), F.lit(")")), F.lit(""))))
    struct = F.when(F.col("_both.code").isNotNull(), F.struct(F.col("_both.code").alias("code"), conflict.alias("conflict"), F.col("_source").alias("source"), F.col("_basis").alias("basis"), note.alias("note")))
    return named.withColumn("maturity", struct).drop("_code", "_region", "_both", "_source", "_basis")


def blocks(words: DataFrame, heads: DataFrame) -> DataFrame:
    """``words(page, text, x, top)`` with the ``block`` of ``heads(page, block, top)`` that they stand under: the nearest head above on the page."""
    line = words.select("page", "top", "x", "text", F.lit(None).cast("string").alias("block")).unionByName(heads.select("page", "top", F.lit(float("-inf")).alias("x"), F.lit(None).cast("string").alias("text"), "block"))
    w = Window.partitionBy("page").orderBy("top", "x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn("block", F.last("block", ignorenulls=True).over(w)).where("text IS NOT NULL")


def glyph_code(red: Column, green: Column, blue: Column, text: Column, legend: dict[str, tuple[float, float, float]], tolerance: float = 0.02) -> Column:
    """Code of a glyph by its colour (within a tolerance of the legend's), a dash for a blank, null for any other."""
    near = lambda c, v: F.abs(c - v) <= tolerance
    by_colour = F.coalesce(*(F.when(near(red, r) & near(green, g) & near(blue, b), code) for code, (r, g, b) in legend.items()), F.lit(None).cast("string"))
    return F.when(F.trim(F.coalesce(text, F.lit(""))).isin("", "-", "–"), "-").otherwise(by_colour)


def year_table(glyphs: DataFrame, columns: DataFrame, tolerance: float = 7.0) -> DataFrame:
    """``block, vintage, code``: each glyph's code under its nearest year; of two in one cell the nearer counts, years without a glyph are ``-``."""
    near = nearest_column(glyphs.select("page", "block", "x", "code"), columns, tolerance).where("year IS NOT NULL")
    told = near.join(dealt(columns.select("page", "year", F.col("x").alias("_x"))), ["page", "year"]).groupBy("block", "year").agg(F.min_by("code", F.struct(F.abs(F.col("x") - F.col("_x")), F.col("code"))).alias("code"))
    every = near.select("page", "block").distinct().join(dealt(columns.select("page", "year")), "page").select("block", "year").distinct()
    return every.join(dealt(told), ["block", "year"], "left").select("block", F.col("year").alias("vintage"), F.coalesce("code", F.lit("-")).alias("code"))


def nearest_column(glyphs: DataFrame, columns: DataFrame, tolerance: float = 7.0) -> DataFrame:
    """Each glyph's year: the column whose ``x`` is nearest, within a tolerance. Positions are binned, so the join is by equality."""
    width = 2 * tolerance
    a = glyphs.withColumn("_bin", F.floor(F.col("x") / width))
    b = columns.select("page", "year", F.col("x").alias("cx"), F.explode(F.array(*(F.floor(F.col("x") / width) + k for k in (-1, 0, 1)))).alias("_bin"))
    near = a.join(dealt(b), ["page", "_bin"]).where(F.abs(F.col("x") - F.col("cx")) <= tolerance)
    return near.groupBy(*glyphs.columns).agg(F.min_by("year", F.struct(F.abs(F.col("x") - F.col("cx")), F.col("year"))).alias("year"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """``region, wine_type, vintage, code, quality`` rows of a YAML table with ``entries``; years are keys."""
    import yaml

    with open(path, encoding="utf-8") as f:
        raw = (yaml.safe_load(f) or {}).get("entries") or []
    rows = [(e.get("region") or "", e.get("wine_type") or "unbekannt", int(y), c, (e.get("quality") or {}).get(y)) for e in raw for y, c in (e.get("maturity") or {}).items()]
    return spark.createDataFrame(rows, "region string, wine_type string, vintage int, code string, quality string")
