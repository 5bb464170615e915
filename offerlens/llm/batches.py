"""Arrow-batched Python stages over columns as lists, nulls as None."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_held: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps between batches: one such memory at a time, as workers serve one operator after another."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


#: Rows given to a function at once, so that its own arrays stay small beside the batch.
ROWS = 400


def map_columns(df: DataFrame, schema: str, fn: Callable[..., dict[str, Any]], rows: int = ROWS) -> DataFrame:
    """``fn(**columns)`` on at most ``rows`` rows at a time; it returns columns of ``schema`` of any one length."""
    wanted: pa.Schema = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, rows):
                part = b.slice(a, rows)
                got = fn(**{n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in wanted], schema=wanted)

    return df.mapInArrow(run, schema)


def stream_groups(df: DataFrame, keys: list[str], schema: str, fn: Callable[..., dict[str, Any]], order: list[str] | None = None) -> DataFrame:
    """``fn(starts, **columns)`` on runs of whole groups of equal long ``keys``.

    Rows are dealt by the keys and sorted in their task; groups pass through as
    a stream, so a task holds one Arrow batch and the group that it ends in.
    ``starts`` are the groups' first places. For groups of bounded size.
    """
    wanted: pa.Schema = to_arrow_schema(StructType.fromDDL(schema))

    def given(t: pa.Table) -> tuple[np.ndarray, pa.RecordBatch]:
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        got = fn(starts, **{n: t.column(n) for n in t.column_names})
        return starts, pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in wanted], schema=wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            new = np.zeros(b.num_rows, dtype=bool)
            for k in keys:
                v = b.column(b.schema.get_field_index(k)).to_numpy()
                new[1:] |= v[1:] != v[:-1]
                new[0] |= bool(rest) and rest[-1].column(rest[-1].schema.get_field_index(k))[-1].as_py() != v[0]
            cuts = np.flatnonzero(new)
            if len(cuts):
                done = [*rest, b.slice(0, cuts[-1])]
                rest = [b.slice(cuts[-1])]
                if sum(x.num_rows for x in done):
                    yield given(pa.Table.from_batches(done))[1]
            else:
                rest.append(b)
        if rest:
            yield given(pa.Table.from_batches(rest))[1]

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def rewrite_rows(df: DataFrame, fn: Callable[[list], tuple[list[bool], list | None]], rows: int = ROWS) -> DataFrame:
    """The rows whose ``text`` ``fn`` keeps, every column of them, with new texts where it gives any; nothing is shuffled.

    ``fn`` takes texts and returns which to keep and, or None, what they become; a new
    text's length replaces ``n_chars`` where there is such a column.
    """
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, rows):
                part = b.slice(a, rows)
                old = part.column(part.schema.get_field_index("text")).to_pylist()
                keep, new = fn(old)
                columns = dict(zip(part.schema.names, part.columns, strict=True))
                if new is not None:
                    columns["text"] = pa.array(new, type=schema.field("text").type)
                    if "n_chars" in columns and any(x != y for x, y in zip(old, new, strict=True)):
                        n = [m if x == y else len(y) for m, x, y in zip(columns["n_chars"].to_pylist(), old, new, strict=True)]
                        columns["n_chars"] = pa.array(n, type=schema.field("n_chars").type)
                out = pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)
                yield out.filter(pa.array(keep, type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
