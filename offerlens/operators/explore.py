"""Filters, facets and rankings of the interactive page and the reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed values.
GOOD_RATING, CHEAP_PRICE = 4.3, 20.0
PAGE_ROWS = 50


@dataclass
class Filters:
    """What a user chose; every unset part lets all rows pass. Missing values answer to ``"?"``."""

    choices: dict[str, list[str]] = field(default_factory=dict)
    text: str = ""
    text_columns: tuple[str, ...] = ("name",)
    min_rating: float | None = None
    max_price: float | None = None
    only: tuple[str, ...] = ()
    hide: tuple[str, ...] = ()

    def predicates(self) -> dict[str, Column]:
        """One condition per group, by the group's name."""
        out: dict[str, Column] = {}
        for c, values in self.choices.items():
            if values:
                out[c] = F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("?")).isin(*values)
        if self.text:
            out["text"] = F.lower(F.concat_ws(" ", *self.text_columns)).contains(self.text.lower())
        if self.min_rating is not None:
            out["rating"] = F.col("rating") >= self.min_rating
        if self.max_price is not None:
            out["price"] = F.col("price") <= self.max_price
        for c in self.only:
            out[c] = F.coalesce(F.col(c), F.lit(False))
        for c in self.hide:
            out["hide_" + c] = ~F.coalesce(F.col(c), F.lit(False))
        return out

    def where(self, rows: DataFrame, besides: str | None = None) -> DataFrame:
        for name, p in self.predicates().items():
            if name != besides:
                rows = rows.where(p)
        return rows


def facet_counts(rows: DataFrame, filters: Filters, facets: list[str]) -> DataFrame:
    """``facet, value, n``: counts per value under all filters but the facet's own.

    One pass: each row is sent once for every facet whose other filters it
    passes, as a partial count.
    """
    preds = filters.predicates()
    every = lambda skip: _all(p for n, p in preds.items() if n != skip)
    entries = F.array(*(F.when(every(f), F.struct(F.lit(f).alias("facet"), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("?")).alias("value"))) for f in facets))
    long = rows.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
    return long.groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n"))


def _all(conditions: object) -> Column:
    out: Column | None = None
    for c in conditions:  # type: ignore[attr-defined]
        c = F.coalesce(c, F.lit(False))
        out = c if out is None else out & c
    return F.lit(True) if out is None else out


def good_and_cheap(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("rating") >= GOOD_RATING) & (F.col("price") <= CHEAP_PRICE))


def sort_rows(rows: DataFrame, by: str, descending: bool = False, tie: str = "id", collation: str | None = None) -> DataFrame:
    """Ordered rows with nulls last in both directions."""
    c = F.collate(F.col(by), collation) if collation else F.col(by)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(tie))


def page(rows: DataFrame, number: int, size: int = PAGE_ROWS) -> DataFrame:
    return rows.offset(number * size).limit(size)


def top_per_group(rows: DataFrame, group: str, by: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps no more than ``k`` per group and task before the shuffle."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*by))).where(F.col("position") <= k)


def label_greedily(points: list[dict], reach: Callable[[dict], tuple[float, float, float, float]], most: int = 8) -> list[dict]:
    """Points whose boxes do not overlap, best rating for the root of the price first. For the few points of a chart."""
    taken: list[tuple[float, float, float, float]] = []
    out = []
    for p in sorted(points, key=lambda p: -p["rating"] / max(p["price"], 1e-9) ** 0.5):
        box = reach(p)
        if all(box[2] <= t[0] or t[2] <= box[0] or box[3] <= t[1] or t[3] <= box[1] for t in taken):
            taken.append(box)
            out.append(p)
        if len(out) == most:
            break
    return out


def grape_flags(names: list[Column], grapes: dict[str, str]) -> Column:
    """Keys of the patterns that stand as words in any of the names."""
    hay = F.concat_ws(" ", *names)
    edge = "a-zäöüéèàç"
    return F.filter(F.array(*(F.when(hay.rlike(f"(?iu)(?<![{edge}]){p}(?![{edge}])"), F.lit(k)) for k, p in grapes.items())), lambda k: k.isNotNull())
