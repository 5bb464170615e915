"""Bounded samples of labelled rows for fitting the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bytes of text that a sample brings to the driver at most, and longest text that it may hold.
MAX_BYTES, MAX_TEXT = 128 << 20, 1 << 20
#: Values of a group column that a sample is taken for; each is a model of its own.
MAX_GROUPS = 200


def fold(column: str, folds: int) -> Column:
    """Remainder of the CRC-32 of an id's decimal text."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def _order(df: DataFrame, key: str) -> list[Column]:
    """A hash of the key, then all columns, so that the order does not depend on where rows lie."""
    return [F.xxhash64(key, F.lit(17)), F.col(key), *(F.col(c) for c in df.columns if c != key)]


def bounded(df: DataFrame, key: str, rows: int, group: str | None = None) -> DataFrame:
    """At most ``rows`` rows (of each non-null ``group`` value, of which there may be ``MAX_GROUPS``), picked by a hash of ``key``.

    A first pass counts, so the filter below already drops nearly everything
    that the final top-k would drop, in the scan's own stage. All groups are
    picked in one more pass, however many there are.
    """
    part = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_000))
    if group is None:
        n = df.count()
        share = min(1.0, 1.2 * rows / max(n, 1) + 20 / max(n, 1))
        return df.where(part < int(share * 1_000_000) + 1).orderBy(*_order(df, key)).limit(rows)
    counts = df.where(F.col(group).isNotNull()).groupBy(group).count().limit(MAX_GROUPS + 1).collect()
    if len(counts) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} values of {group}")
    if not counts:
        return df.limit(0)
    shares = {r[group]: int(min(1.0, (1.2 * rows + 20) / max(r["count"], 1)) * 1_000_000) + 1 for r in counts}
    if max(shares.values()) <= 1_000_000:  # a text is read only where its row may be picked
        common = df.where(F.col(group).isNotNull() & (part < max(shares.values())))
    else:
        common = df.where(F.col(group).isNotNull())
    share = F.create_map(*(F.lit(x) for kv in sorted(shares.items(), key=str) for x in kv))
    near = common.where(part < F.element_at(share, F.col(group)))
    first = Window.partitionBy(group).orderBy(*_order(df, key))
    place = next(c for k in range(len(df.columns) + 1) if (c := f"_place{k}") not in df.columns)
    return near.withColumn(place, F.row_number().over(first)).where(F.col(place) <= rows).drop(place)


def within_bytes(rows: DataFrame, key: str, text: str, group: str | None = None, most: int = MAX_BYTES) -> DataFrame:
    """Those of a bounded sample's rows whose texts together hold at most ``most`` bytes (of each group), by the hash of ``key``.

    Texts over ``MAX_TEXT`` bytes are left out whole, so one text cannot fill the
    driver. Only fitting is bounded so; scoring reads every text.
    """
    size = F.octet_length(F.coalesce(F.col(text), F.lit("")))
    taken = [c for c in ("_size", "_sum") if c in rows.columns]
    if taken:
        raise ValueError(f"columns {taken} are in use")
    ahead = Window.partitionBy(*([group] if group else [])).orderBy(*_order(rows, key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = rows.withColumn("_size", size).where(F.col("_size") <= MAX_TEXT).withColumn("_sum", F.sum(F.col("_size").cast("long")).over(ahead))
    return kept.where(F.col("_sum") <= most).drop("_size", "_sum")


def labelled_texts(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> list[tuple[str | None, int]]:
    """``(text, 0 or 1)`` of at most ``rows`` labelled documents and ``MAX_BYTES`` of text, by id.

    Labels of repeated ids count by their majority; of repeated documents with
    different texts the first in order of text counts.
    """
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y"))
    chosen = F.broadcast(bounded(known, "doc_id", rows))
    found = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return [(r["text"], r["y"]) for r in sorted(within_bytes(found, "doc_id", "text").collect(), key=lambda r: r["doc_id"])]
