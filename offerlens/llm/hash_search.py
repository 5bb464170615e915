"""Nearest neighbours by multi-index hashing of learned binary codes.

Several rotations are learned from a bounded sample (principal axes, then
alternating between codes and the rotation that fits them best); the signs of a
rotated unit vector are its code. Codes are cut into substrings of one byte, and
every shard of the index keeps, for each substring, its rows by byte value. By
the pigeonhole principle a code within distance ``m (r + 1) - 1`` of the query
agrees with one of its ``m`` substrings up to ``r`` bits, so probing the buckets
within ``r`` bits of each retrieves every code within that radius. The radius
grows until it holds one in ``SHARE`` codes of the shard; those are reranked by the
cosine of the original vectors in double precision.

Every row is indexed. Equal vectors are one entry that keeps its ``k + 1``
smallest ids, which suffices as ties go to the smaller id. Queries go through the
shards in blocks: a shard's index is built once for ``QUERIES`` of them, and what is
shuffled is each entry once per block and each query once per shard.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component take no part, nor do rows with a null id; a query's own id is no candidate
of it; rows that repeat an id are one query and one candidate, which counts with its
best score; vectors of other length are no candidates; fewer rows than ``k`` if
there are fewer candidates; an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .batches import stream_groups
from .scratch import Scratch
from .vectors import matrix, sample, unit, usable, widths

BITS = 256
#: Codes that a shard's radius must hold at least, and one in how many; rows of a shard; queries of a block.
ENOUGH, SHARE, SHARD, QUERIES = 256, 32, 32_768, 16_384

_POP = np.asarray([bin(v).count("1") for v in range(256)], dtype=np.uint8)
#: Byte values in order of their distance from 0, and how many lie within each distance.
_NEAR = np.argsort(_POP, kind="stable").astype(np.uint8)
_WITHIN = np.cumsum(np.bincount(_POP))


def rotations(x: np.ndarray, bits: int = BITS, rounds: int = 25, seed: int = 3) -> np.ndarray:
    """Columns that turn unit vectors of the sample's width into ``bits`` signed values."""
    width = x.shape[1]
    rng = np.random.default_rng(seed)
    mean = x.T @ x / len(x)
    _, axes = np.linalg.eigh(mean)
    out = []
    while sum(o.shape[1] for o in out) < bits:
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        v = x @ axes
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(np.sign(v @ turn).T @ v)
            turn = (u @ wt).T
        out.append(axes @ turn)
    return np.concatenate(out, axis=1)[:, :bits]


def codes(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes of unit vectors, one byte per substring."""
    return np.packbits(x @ turn > 0, axis=1)


class Shard:
    """Buckets of one shard's codes, by substring and byte value."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.words = np.ascontiguousarray(code).view(np.uint64)
        self.order = np.argsort(code, axis=0, kind="stable").T.astype(np.int32)  # one row of places per substring
        self.begin = np.stack([np.searchsorted(np.sort(code[:, j]), np.arange(257)) for j in range(code.shape[1])])

    def probe(self, query: np.ndarray, low: int, high: int) -> np.ndarray:
        """Places whose code has a substring at ``low`` to ``high`` bits from the query's; places repeat."""
        values = query[:, None] ^ _NEAR[None, (_WITHIN[low - 1] if low else 0):_WITHIN[high]]
        sub = np.arange(len(query))[:, None]
        a, b = self.begin[sub, values].ravel(), self.begin[sub, values.astype(np.int64) + 1].ravel()
        size = b - a
        table = np.repeat(np.broadcast_to(sub, values.shape).ravel(), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        return self.order[table, place]

    def within(self, query: np.ndarray, enough: int) -> np.ndarray:
        """Every place within the smallest radius, in whole probing steps, that holds ``enough`` codes (or all)."""
        m, n = self.code.shape[1], len(self.code)
        enough = min(enough, n)
        seen = np.zeros(n, dtype=bool)
        words = np.ascontiguousarray(query).view(np.uint64)
        for r in range(9):
            seen[self.probe(query, r, r)] = True
            if seen.sum() < enough and r < 8:
                continue
            at = np.flatnonzero(seen)
            far = np.bitwise_count(self.words[at] ^ words).sum(1)
            radius = m * (r + 1) - 1 if r < 8 else 8 * m
            safe = far <= radius
            if safe.sum() >= enough:  # the radius shrinks to the smallest that still holds enough
                least = np.partition(far[safe], enough - 1)[enough - 1]
                return at[far <= least]
        return np.arange(n)


def search(table: DataFrame, k: int = 5, every: int = 50, enough: int = ENOUGH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every row whose id ``every`` divides.

    A shard's radius holds ``enough`` of its codes, and at least one in ``SHARE``.
    """
    scratch = Scratch(table.sparkSession, "search")
    rows = table.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    keyed = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.hash("embedding"))
    # the k+1 smallest ids of equal vectors: first by parts, so that no task gathers a frequent vector's ids
    part = Window.partitionBy("h1", "h2", "salt").orderBy("vec_id")
    whole = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = keyed.select("h1", "h2", "vec_id").distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = few.withColumn("r", F.row_number().over(part)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k + 1)
    ids = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    vectors = keyed.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"))
    entries = scratch.save(vectors.join(ids, ["h1", "h2"]).select("ids", "embedding"))
    queries = rows.where(F.col("vec_id") % every == 0)
    found = None
    for width in widths(entries):
        got = _of_width(entries.where(F.size("embedding") == width), queries.where(F.size("embedding") == width), width, k, enough, scratch)
        found = got if found is None else found.unionByName(got)
    if found is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return scratch.finish(once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _of_width(entries: DataFrame, queries: DataFrame, width: int, k: int, enough: int, scratch: Scratch) -> DataFrame:
    spark = entries.sparkSession
    turn = rotations(sample(entries.select(F.col("ids")[0].alias("vec_id"), "embedding"), width))
    shared = spark.sparkContext.broadcast(turn)
    shards, blocks = -(-entries.count() // SHARD), -(-max(queries.count(), 1) // QUERIES)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    index = entries.select(deal("ids", shards).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
                           "ids", "embedding", F.lit(None).cast("long").alias("query_id"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), deal("vec_id", blocks).alias("block"),
                           F.lit(None).cast("array<long>").alias("ids"), "embedding", F.col("vec_id").alias("query_id"))

    def run(starts: np.ndarray, ids: pa.ChunkedArray, embedding: pa.ChunkedArray, query_id: pa.ChunkedArray, **_: pa.ChunkedArray) -> dict:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        turn = shared.value
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            x = unit(matrix(embedding.slice(a, b - a), width))
            who = query_id.slice(a, b - a).to_pylist()
            named = ids.slice(a, b - a).to_pylist()
            own = np.flatnonzero([w is None for w in who])
            asks = np.flatnonzero([w is not None for w in who])
            if not len(own) or not len(asks):
                continue
            shard, ask = Shard(codes(x[own], turn)), codes(x[asks], turn)
            for i, code in zip(asks, ask, strict=True):
                at = own[shard.within(code, max(enough, len(own) // SHARE))]
                score = x[at] @ x[i]
                edge = np.partition(score, -k - 1)[-k - 1] if len(at) > k + 1 else -np.inf
                near = score >= edge  # the query's own entry, k others, and ties at the edge until ids decide
                for j, s in zip(at[near], np.clip(score[near], -1, 1).tolist(), strict=True):
                    for v in named[j]:
                        if v != who[i]:
                            out["query_id"].append(who[i])
                            out["vec_id"].append(v)
                            out["score"].append(s)
        return out

    both = index.unionByName(asked)
    return scratch.save(stream_groups(both, ["shard", "block"], "query_id long, vec_id long, score double", run))
