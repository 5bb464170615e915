"""A Bloom filter of long keys that decides most rows of a scan before they are shuffled."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Bits at most (16 MB, what a worker holds), bits for each key, and hashes. With more keys than a third of the bits it decides nothing.
MAX_BITS, PER_KEY, HASHES = 1 << 27, 10, 3


def bits_for(keys: int) -> int:
    """A power of two, or 0 if a filter of so many keys would let nearly all rows through."""
    bits = 1 << 10
    while bits < keys * PER_KEY and bits < MAX_BITS:
        bits *= 2
    return bits if 3 * keys <= bits else 0


def may_hold(keys: DataFrame, column: str, size: int) -> Column | None:
    """Whether the value of ``column`` may be among ``keys`` (of the same name, ``size`` of them); None where a filter is of no use.

    True for every key, and for about one in fifty other values.
    """
    bits = bits_for(size)
    if not bits:
        return None
    at = F.explode(F.array(*(F.shiftrightunsigned(F.xxhash64(column, F.lit(i)), 64 - bits.bit_length() + 1) for i in range(HASHES)))).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        hit = np.ones(len(a), dtype=bool)
        for v in (a, b, c):
            p = v.to_numpy().astype(np.int64)
            hit &= (shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(hit)

    return test(*(F.shiftrightunsigned(F.xxhash64(column, F.lit(i)), 64 - bits.bit_length() + 1) for i in range(HASHES)))


def fetch(rows: DataFrame, keys: DataFrame, on: list[str], size: int, small: int) -> DataFrame:
    """Rows joined with the ``size`` rows of ``keys`` on the columns ``on``: a row comes as often as ``keys`` asks for it.

    Up to ``small`` keys are broadcast. Beyond, a Bloom filter of the first key
    column drops most other rows in the scan, and what it lets through is shuffled.
    """
    if size <= small:
        return rows.join(F.broadcast(keys), on)
    maybe = may_hold(keys, on[0], size)
    return (rows if maybe is None else rows.where(maybe)).join(keys.hint("shuffle_hash"), on)


def anti_join(rows: DataFrame, keys: DataFrame, on: list[str], size: int, small: int) -> DataFrame:
    """Rows whose ``on`` columns are not among ``keys`` (distinct, ``size`` of them); null keys stay. Rows that miss the filter stay where they are."""
    if size <= small:
        return rows.join(F.broadcast(keys), on, "left_anti").select(*rows.columns)
    maybe = may_hold(keys, on[0], size)
    if maybe is None:
        return rows.join(keys.hint("shuffle_hash"), on, "left_anti").select(*rows.columns)
    flag = next(c for k in range(len(rows.columns) + 1) if (c := f"_maybe{k}") not in rows.columns)
    marked = rows.withColumn(flag, maybe & F.col(on[0]).isNotNull())
    stay = marked.where(~F.col(flag))
    return stay.unionByName(marked.where(flag).join(keys.hint("shuffle_hash"), on, "left_anti").select(*marked.columns)).select(*rows.columns)
