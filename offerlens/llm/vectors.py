"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .sampling import bounded

#: Rows of the bounded sample that rotations are learned from.
SAMPLE = 20_000
#: Bytes of the sample in double precision.
SAMPLE_BYTES = 64 << 20


def usable(column: str) -> Column:
    """True for vectors that take part: no null or non-finite component, and not all zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` entries, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def widths(vectors: DataFrame) -> list[int]:
    """Lengths of the vectors, most frequent first; rows of other lengths are compared only among themselves."""
    rows = vectors.groupBy(F.size("embedding").alias("w")).count().collect()
    return [r["w"] for r in sorted(rows, key=lambda r: (-r["count"], r["w"]))]


def sample(vectors: DataFrame, width: int, rows: int = SAMPLE) -> np.ndarray:
    """Unit vectors of a sample of ``(key, embedding)`` rows of one width, in double precision: at most ``rows``, and at most ``SAMPLE_BYTES``."""
    key, _ = vectors.columns
    got = bounded(vectors, key, max(1, min(rows, SAMPLE_BYTES // (8 * width)))).toArrow()
    return unit(matrix(got.column("embedding"), width)) if got.num_rows else np.zeros((0, width))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safely for very large or small components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)
