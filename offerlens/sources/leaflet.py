"""Leaflet pages: words with places become cells around anchors, by range joins and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as X
from ..operators.small import dealt

# Fixed values.
UNIT = r"(?iu)^(?:\d+(?:[.,]\d+)?\s*(?:cl|ml|dl|l|lt)|kg|g|st(?:ü|u)ck|stk|liter)$"
BY_WEIGHT = r"(?i)^(?:kg|g|st)"
PRICE = r"^\d{1,4}[.,]\d{2}$"
INSTEAD = r"(?i)statt\s*([\d.,]+)"
DISCOUNT = r"^-\d{1,2}\s*%$"
PACK = r"(?i)\b\d{1,3}\s*[x×]\s*\d+(?:[.,]\d+)?\s*(?:cl|ml|dl|l|g|kg)\b"
NOISE = (r"(?iu)immer g(?:ü|u)nstig|abholen|preis(?:ä|a)nderungen|mengenbeschr|vorbehalten|alle aktionen|internet|aktionen$|dauertief|exklusive mwst|inklusive vrg|^aktion$|^neu$"
         r"|\d{1,2}\.\d{1,2}\.\s*[–-]\s*\d{1,2}\.\d{1,2}\.")
ABOVE, BELOW = (-200.0, -4.0), (4.0, 95.0)
LINE_GAP = 3.0


def clusters(values: DataFrame, by: list[str], x: str, gap: float) -> DataFrame:
    """Number the runs of values that lie within ``gap`` of their neighbour, in each group."""
    w = Window.partitionBy(*by).orderBy(x)
    jump = (F.col(x) - F.lag(x).over(w) > gap).cast("int")
    return values.withColumn("cluster", F.sum(F.coalesce(jump, F.lit(0))).over(w))


def column_bounds(anchors: DataFrame, gap: float = 40.0) -> DataFrame:
    """``page, column, left, right``: anchors in clusters by ``x0``, each reaching to the middle of the way to the next."""
    centre = clusters(anchors, ["page"], "x0", gap).groupBy("page", F.col("cluster").alias("column")).agg(F.avg("x0").alias("c"))
    w = Window.partitionBy("page").orderBy("c")
    left = F.coalesce((F.lag("c").over(w) + F.col("c")) / 2, F.lit(float("-inf")))
    right = F.coalesce((F.lead("c").over(w) + F.col("c")) / 2, F.lit(float("inf")))
    return centre.select("page", "column", left.alias("left"), right.alias("right"))


def cells(words: DataFrame, anchors: DataFrame, bin_height: float = 100.0) -> DataFrame:
    """``page, anchor, lines, above, below``: the words around each anchor in its column, as lines from top to bottom.

    ``words(page, text, x0, top)`` and ``anchors(page, anchor, x0, top)``. The range
    condition on height is turned into equality on bins before it is checked.
    """
    bounds = column_bounds(anchors)
    placed = lambda t: t.join(dealt(bounds), "page").where((F.col("x0") >= F.col("left")) & (F.col("x0") < F.col("right"))).drop("left", "right")
    bins = F.sequence(F.floor((F.col("at") + ABOVE[0]) / bin_height), F.floor((F.col("at") + BELOW[1]) / bin_height))
    a = placed(anchors).select("page", "column", "anchor", F.col("top").alias("at")).withColumn("_bin", F.explode(bins))
    w = placed(words).withColumn("_bin", F.floor(F.col("top") / bin_height))
    off = F.col("top") - F.col("at")
    met = w.join(dealt(a), ["page", "column", "_bin"]).where(off.between(*ABOVE) | off.between(*BELOW)).drop("_bin")
    # a word between two anchors belongs to the one it stands nearer to
    near = Window.partitionBy("page", "column", "text", "x0", "top").orderBy(F.abs(off), "anchor")
    met = met.withColumn("_r", F.row_number().over(near)).where("_r = 1")
    lines = clusters(met, ["page", "anchor"], "top", LINE_GAP)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda p: p["text"]), " ")
    one = lines.groupBy("page", "anchor", "cluster").agg(text.alias("line"), F.min("top").alias("top"))
    at = one.join(dealt(anchors.select("page", "anchor", F.col("top").alias("at"))), ["page", "anchor"])
    lines = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("top", "line")))), lambda p: p["line"])
    return at.groupBy("page", "anchor").agg(lines(F.lit(True)).alias("lines"), lines(F.col("top") < F.col("at")).alias("above"), lines(F.col("top") >= F.col("at")).alias("below"))


def cell_fields(cells: DataFrame, places: list[str] = ()) -> DataFrame:
    """``name, amount, reference, unit, pack`` of ``cells(above, below)``, arrays of lines from top to bottom.

    The unit and the price are the lowest such lines above the anchor; a struck
    price may stand on either side; the name is what is left below it, without
    layout lines and lines that only name a place.
    """
    trimmed = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.trim(t))
    up, down = F.reverse(trimmed("above")), trimmed("below")
    first = lambda lines, pattern: F.get(F.filter(lines, lambda t: t.rlike(pattern)), F.lit(0))
    struck = F.regexp_extract(F.coalesce(first(up, INSTEAD), first(down, INSTEAD)), INSTEAD, 1)
    pack = F.regexp_extract(first(F.concat(down, trimmed("above")), PACK), PACK, 0)
    place = r"(?iu)^(?:" + "|".join(places) + r")$" if places else r"(?!)"
    plain = lambda t: (t != "") & ~t.rlike(NOISE) & ~t.rlike(place) & ~t.rlike("^" + PACK.replace("(?i)", "(?i)") + "$") & ~t.rlike(INSTEAD) & ~t.rlike(UNIT) & ~t.rlike(PRICE) & ~t.rlike(DISCOUNT) & ~t.rlike(r"^\d+$")
    return cells.withColumns({
        "unit": F.coalesce(first(up, UNIT), F.lit("")), "amount": X.parse_price(first(up, PRICE)), "reference": X.parse_price(struck), "pack": F.coalesce(pack, F.lit("")),
        "name": F.array_join(F.filter(down, plain), " ")})


def leaflet_records(fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records for ``make_offers``, prices without tax, and the positions that are not sure, with why."""
    doubt = F.when(F.col("amount").isNull(), "no price").when(F.col("unit") == "", "no unit").when(F.col("unit").rlike(BY_WEIGHT), "not by the bottle")
    named = fields.where("name <> ''").withColumn("doubt", doubt)
    sure = named.where("doubt IS NULL").withColumns({"basis_text": F.col("unit"), "vat": F.lit(False), "note": F.concat_ws(", ", F.lit("leaflet"), F.nullif("pack", F.lit("")))}).drop("doubt", "pack", "unit", "above", "below")
    return sure, named.where("doubt IS NOT NULL")


def split_sure(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions that were read surely, and those to look at."""
    sure = F.col("price").isNotNull() & (F.col("confidence") != "low") & (F.length("name") > 0)
    return offers.where(sure), offers.where(~sure)


def newest_leaflet(urls: DataFrame, url: str = "url") -> DataFrame:
    """The leaflet whose year, month and calendar week are the latest, as numbers."""
    part = lambda p: F.coalesce(F.nullif(F.regexp_extract(url, p, 1), F.lit("")).cast("int"), F.lit(0))
    key = F.struct(part(r"(20\d\d)").alias("y"), part(r"20\d\d[-_/](\d{1,2})(?!\d)").alias("m"), part(r"(?i)kw[-_ ]?(\d{1,2})").alias("w"))
    return urls.agg(F.max_by(url, key).alias(url))
