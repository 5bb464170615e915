"""Near-duplicate documents by a chosen-path set similarity join.

Documents whose shingle sets are equal become one class first. Every class has a
signature of ``POSITIONS`` minwise tokens. In each of at least ``TREES`` independent
trees a node picks a position (and with probability ``1/0.75 - 1`` a second one),
and its documents branch by their token there: on average a pair at the
threshold keeps one common child per level, so a tree loses it slowly, but more
surely with each level. From depth ``FIRST`` on, nodes in which no more than ``SMALL`` pairs per member are
of different components are compared exhaustively; others branch again. Documents
in nodes that are still crowded at depth ``SHALLOW`` go through more trees, as
many as ``trees_for`` asks at the depth reached, so that a pair at the threshold
is lost with a probability of at most 0.008 at every depth.

A group of m near copies never separates in a tree, so first, in nodes of a fixed
depth, all members are compared with the node's first member only. Trees then
skip what is one component already: a node is followed only while it holds
two components, which loses no link between components, and links inside one
change no result. Candidates are confirmed on full shingle sets: the comparisons
of one document are split into parts, and in a part the document comes first and
the others stream past it, so a task holds two sets. Texts are fetched by id and
hash; a Bloom filter keeps what nobody asks for out of that shuffle. Nodes, leaders
and classes that hold many rows meet their partners by broadcast.

Defined results: null, empty and wordless texts have an empty set, link with
nothing and are kept; repeated rows share a class; rows that repeat an id with
another text are compared each by its own text, and their component is the smallest
id reachable from that text; rows without an id link with nothing, have no
component and are kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bloom
from .batches import map_columns, stream_groups
from .graph import components
from .scratch import Scratch
from .shingles import shingle_set
from .skew import join_hot

#: Minwise tokens, trees, and comparisons for each member up to which a node is compared exhaustively.
POSITIONS, TREES, SMALL = 128, 10, 128
#: Members of a node's largest component that one task compares with all others.
SLICE = 512
#: Depth of the nodes whose members are compared with one member, and how many such nodes a document is in.
LEADER_DEPTH, LEADER_NODES = 4, 16
#: Positions that must agree before sets are compared: four standard errors under what similarity 0.75 gives.
AGREE = 77
MAX_DEPTH = 30
#: Depth at which the first trees' nodes are looked at: above, most nodes are large and hold unlike documents.
FIRST = 3
#: Depth to which ``TREES`` are enough, and the share of pairs of similarity 0.75 that all trees may lose.
SHALLOW, MISS = 5, 0.004
#: Smallest hashes of a set kept beside the signature. A set of no more is there whole, so its similarities are exact;
#: for others the estimate may fall short of 0.75 by four standard errors.
LOWEST, EXACT_AT, GUESS_AT = 256, 0.749, 0.64
#: Comparisons with one document that go through one group.
CHUNK = 512
#: Ids whose set is broadcast at most; above, the join shuffles.
BROADCAST_IDS = 500_000

_A = np.random.default_rng(11).integers(1, 2**31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens of non-empty sets: int32, one row of ``POSITIONS`` per set."""
    out = np.zeros((len(sets), POSITIONS), dtype=np.int32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x, y = np.empty_like(low), np.empty_like(low)
    for k in range(POSITIONS):
        np.multiply(low, _A[k], out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        out[:, k] = np.minimum.reduceat(x, starts).view(np.int32)
    return out


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, h`` (hash of the text), ``n_shingles, print`` (128-bit print of the set), ``sig``, ``short`` (its low halves) and ``low``; the last four are null for empty sets."""

    def run(doc_id: list, h: list, text: list) -> dict:
        sets = [shingle_set(t) for t in text]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig: list = [None] * len(sets)
        mark: list = [None] * len(sets)
        low: list = [None] * len(sets)
        short: list = [None] * len(sets)
        for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
            sig[i] = row
            short[i] = row.astype("<i2").tobytes()
            low[i] = (sets[i][:LOWEST] >> np.uint64(32)).astype("<u4").tobytes()
            mark[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
        return {"doc_id": doc_id, "h": h, "n_shingles": [len(s) for s in sets], "print": mark, "sig": sig, "short": short, "low": low}

    return map_columns(_keyed(docs), "doc_id long, h long, n_shingles long, print binary, sig array<int>, short binary, low binary", run)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")


def may_be_near(a: np.ndarray, b: np.ndarray) -> bool:
    """False if the smallest hashes of two sets show that they are not similar enough."""
    whole = len(a) < LOWEST and len(b) < LOWEST
    if not whole:  # both sets are known up to here
        top = min(x[-1] for x in (a, b) if len(x) == LOWEST)
        a, b = a[:np.searchsorted(a, top, "right")], b[:np.searchsorted(b, top, "right")]
    both = np.concatenate([a, b])
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return common >= (EXACT_AT if whole else GUESS_AT) * (len(both) - common)


def near_enough(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted distinct hashes."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < 75 * large:
        return False
    both = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, places: DataFrame, docs: DataFrame, once: bool, scratch: Scratch) -> DataFrame:
    """The pairs ``(u, v)`` whose full sets are near enough; ``places`` has the id and text hash of the row that stands for each class.

    ``once``: no two rows of ``docs`` have the same id.
    """
    pairs = scratch.save(pairs.distinct())
    n = pairs.count()
    degree = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / CHUNK)
    split = (pairs.join(F.broadcast(degree), "u") if n <= BROADCAST_IDS else join_hot(pairs, degree, ["u"], counts=degree, rows=n)).withColumn("part", F.pmod(F.xxhash64("v"), parts))
    split = scratch.save(split.select("u", "part", "v"))
    asked = split.select("u", "part", F.col("v").alias("id"), F.lit(1).alias("turn")).unionByName(
        split.select("u", "part", F.col("u").alias("id"), F.lit(0).alias("turn")).distinct())
    asked = scratch.save(asked)
    asked = scratch.save(bloom.fetch(places, asked, ["id"], asked.count(), BROADCAST_IDS))
    texts = _keyed(docs)
    if not once:  # equal rows: one of them speaks for all
        keys = asked.select("doc_id", "h").distinct()
        texts = bloom.fetch(texts, keys, ["doc_id", "h"], keys.count(), BROADCAST_IDS).dropDuplicates(["doc_id", "h"])
    sent = bloom.fetch(texts, asked, ["doc_id", "h"], asked.count(), BROADCAST_IDS)
    sent = sent.repartition("u", "part").sortWithinPartitions("u", "part", "turn").select("u", "part", "turn", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine = None, np.zeros(0, dtype=np.uint64)
        for b in batches:
            u, part, turn, who = (b.column(k).to_pylist() for k in range(4))
            text, found = b.column(4), []
            for i in range(b.num_rows):
                if turn[i] == 0:
                    group, mine = (u[i], part[i]), shingle_set(text[i].as_py())
                elif (u[i], part[i]) == group and near_enough(mine, shingle_set(text[i].as_py())):
                    found.append((u[i], who[i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=pa.int64()) for k in (0, 1)], names=["u", "v"])

    found = scratch.save(sent.mapInArrow(run, "u long, v long"))
    for t in (split, pairs, asked):
        scratch.drop(t)
    return found


def _token(sig: Column, at: Column) -> Column:
    return F.element_at(sig, (at + 1).cast("int"))


def leaders(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """``(first member, other member)`` of every node at the fixed depth; the first is the one with the smallest ``doc_id``, as copies tend to be of older texts."""
    nodes = [F.xxhash64(F.lit(b), *(F.col("sig")[(b * LEADER_DEPTH + k) % POSITIONS] for k in range(LEADER_DEPTH))) for b in range(LEADER_NODES)]
    rows = reps.select("id", "doc_id", F.explode(F.array(*nodes)).alias("node"))
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "id")).alias("f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    first = scratch.save(first.select("node", F.col("f.id").alias("u"), "_n"))
    met = join_hot(rows, first.select("node", "u"), ["node"], counts=first.select("node", "_n"), rows=reps.count() * LEADER_NODES, small=BROADCAST_IDS)
    return met.where("u <> id").select("u", F.col("id").alias("v"))


def branch(rows: DataFrame, levels: int = 1) -> DataFrame:
    """Descendants of ``(node, id, comp, sig)`` rows so many levels below: ``(node, id, comp)``."""
    for _ in range(levels):
        rows = _children(rows)
    return rows.drop("sig")


def _children(rows: DataFrame) -> DataFrame:
    pick = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(POSITIONS))
    one, two = pick(1), pick(3)
    extra = (F.pmod(F.xxhash64("node", F.lit(2)), F.lit(3)) == 0) & (one != two)
    child = lambda at: F.xxhash64("node", at, _token(F.col("sig"), at))
    return rows.select("id", "comp", "sig", F.explode(F.when(extra, F.array(child(one), child(two))).otherwise(F.array(child(one)))).alias("node"))


def node_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``u < v`` of different components inside the node parts of ``(node, part, id, comp, short, low)`` that may be near."""

    def run(starts: np.ndarray, id: pa.ChunkedArray, comp: pa.ChunkedArray, short: pa.ChunkedArray, low: pa.ChunkedArray, **_: pa.ChunkedArray) -> dict:  # noqa: A002
        ids, comps = id.to_numpy(), comp.to_numpy()
        sigs = np.frombuffer(b"".join(short.to_pylist()), dtype="<i2").reshape(len(ids), POSITIONS)
        lows = [np.frombuffer(x, dtype="<u4") for x in low.to_pylist()]
        first, second = [], []
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            for i in range(a, b - 1):
                near = ((sigs[i + 1:b] == sigs[i]).sum(1) >= AGREE) & (comps[i + 1:b] != comps[i])
                for j in np.flatnonzero(near) + i + 1:
                    if may_be_near(lows[i], lows[j]):
                        first.append(min(ids[i], ids[j]))
                        second.append(max(ids[i], ids[j]))
        return {"u": first, "v": second}

    return stream_groups(rows, ["node", "part"], "u long, v long", run).distinct()


def settle(rows: DataFrame, last: bool, scratch: Scratch) -> DataFrame:
    """``(node, id, comp, part, done)`` of the nodes that hold two components; ``done`` ones are to be compared now.

    A done node is large only if nearly all of it is one component. That one is
    dealt in slices, and each slice meets all the others, who are few. ``last``:
    what is not done is compared too, each slice with each.
    """
    sizes = rows.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("c"))
    nodes = sizes.groupBy("node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("same"), F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("k"))
    nodes = nodes.where("k > 1").select("node", "n", F.col("top.comp").alias("top"), ((F.col("n") * F.col("n") - F.col("same")) <= 2 * SMALL * F.col("n")).alias("done"))
    nodes = scratch.save(nodes.withColumn("slices", F.when(F.col("done") | F.lit(last), F.ceil(F.col("n") / SLICE)).otherwise(F.lit(1)).cast("long")))
    own = F.pmod(F.xxhash64("id"), F.col("slices"))
    each = F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)
    every = F.transform(each, lambda s: F.least(s, own) * F.col("slices") + F.greatest(s, own))
    part = F.when(~F.col("done") & F.lit(last), every).when(F.col("comp") == F.col("top"), F.array(own)).otherwise(each)
    met = join_hot(rows, nodes.drop("n"), ["node"], counts=nodes.select("node", F.col("n").alias("_n")), rows=rows.count(), small=BROADCAST_IDS)
    return met.select("node", "id", "comp", "done", F.explode(part).alias("part"))


def lost(depth: int, agree: float) -> float:
    """Probability that one tree separates a pair that agrees in this share of positions within so many levels."""
    q = 0.0
    for _ in range(depth):
        s = 1 - agree + agree * q
        q = (2 * s + s * s) / 3
    return q


@cache
def trees_for(depth: int) -> int:
    """Trees that together lose no more than ``MISS`` of the pairs of similarity 0.75, over all signatures these may have."""
    each = [(comb(POSITIONS, k) * 0.75**k * 0.25 ** (POSITIONS - k), lost(depth, k / POSITIONS)) for k in range(AGREE, POSITIONS + 1)]
    trees = TREES
    while sum(share * q**trees for share, q in each) > MISS:
        trees += 1
    return trees


def tree_pairs(reps: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate pairs of different components from all trees."""
    known = F.broadcast(comps) if comps.count() <= BROADCAST_IDS else comps
    start = scratch.save(reps.join(known, "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "sig"))
    sig = start.select("id", "sig")
    found, deep, grown, wanted = None, None, 0, TREES
    while grown < wanted:
        roots = F.explode(F.sequence(F.lit(grown + 1).cast("long"), F.lit(wanted).cast("long")))
        first = FIRST if deep is None else SHALLOW  # a pair that a tree loses above is one of those that ``trees_for`` counts
        rows = branch((start if deep is None else start.join(deep, "id", "left_semi")).withColumn("node", roots), first)
        grown, crowded, done = wanted, None, None
        for depth in range(first, MAX_DEPTH + 1):
            rows = scratch.save(rows)
            live = scratch.save(settle(rows, depth == MAX_DEPTH, scratch))
            scratch.drop(rows)
            now, later = (live, live.limit(0)) if depth == MAX_DEPTH else (live.where("done"), live.where("not done"))
            done = now if done is None else done.unionByName(now)
            if depth == MAX_DEPTH or later.isEmpty():
                break
            if depth == SHALLOW:
                crowded = later.select("id").distinct()
            rows = branch(bloom.fetch(sig, later.select("node", "id", "comp"), ["id"], later.count(), BROADCAST_IDS).select("node", "id", "comp", "sig"))
        # nodes of all depths are compared at once: a node's number holds its depth
        met = bloom.fetch(reps.select("id", "short", "low"), done.select("node", "part", "id", "comp"), ["id"], done.count(), BROADCAST_IDS)
        got = scratch.save(node_pairs(met.select("node", "part", "id", "comp", "short", "low")))
        found = got if found is None else found.unionByName(got)
        if depth > SHALLOW:
            # a pair that is lost below SHALLOW was in one of these nodes until then
            deep = scratch.save(crowded) if deep is None else deep
            wanted = max(wanted, trees_for(depth))
    return found.distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; ``text_hash`` is the text's, and ``first`` marks the rows of
    each component that have its smallest id and, of these, its smallest text hash: one row, unless rows repeat.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sets = scratch.save(sketch(docs).withColumn("row", F.monotonically_increasing_id()))  # written once, so the number stays
    full = sets.where("print is not null and doc_id is not null")
    once = full.groupBy("doc_id").count().where("count > 1").isEmpty()
    classes = full.groupBy("print").agg(F.min(F.struct("doc_id", "h", "row")).alias("rep"), F.count(F.lit(1)).alias("_n"))
    classes = scratch.save(classes.select("print", "_n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h"), F.col("rep.row").alias("id")))
    places = classes.select("id", "doc_id", "h")
    # all rows but those that another one stands for; few are removed, and the rest stay where they are
    several = classes.where("_n > 1").select("print", "id", "_n")
    others = join_hot(full.select("row", "print"), several.select("print", "id"), ["print"], counts=several.select("print", "_n"), rows=full.count(), small=BROADCAST_IDS).where("row <> id")
    others = scratch.save(others.select(F.col("row").alias("id")))
    kept = bloom.anti_join(full.withColumnRenamed("row", "id"), others, ["id"], others.count(), BROADCAST_IDS)
    reps = scratch.save(kept.select("id", "doc_id", "sig", "short", "low"))
    flat = scratch.save(sets.select("doc_id", "h", "n_shingles", "print"))
    scratch.drop(sets)
    starred = confirm(leaders(reps, scratch), places, docs, once, scratch)
    comps = components(starred, scratch)
    more = confirm(tree_pairs(reps, comps, scratch), places, docs, once, scratch)
    at = lambda side: comps.select(F.col("id").alias(side), F.col("component").alias(side + "_comp"))
    met = more.join(at("u"), "u", "left").join(at("v"), "v", "left").select(
        F.coalesce("u_comp", "u").alias("u"), F.coalesce("v_comp", "v").alias("v"))
    joined = components(met, scratch).select(F.col("id").alias("component"), F.col("component").alias("wider"))
    final = classes.select("print", "id", F.struct("doc_id", "h").alias("lead"), "_n").join(F.broadcast(comps) if comps.count() <= BROADCAST_IDS else comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    final = scratch.save(join_hot(final, joined, ["component"], "left", small=BROADCAST_IDS).withColumn("component", F.coalesce("wider", "component")).drop("wider"))
    least = final.groupBy("component").agg(F.min("lead").alias("least"))
    final = scratch.save(join_hot(final, least, ["component"]).select("print", "least", "_n"))
    found = flat.where("print is not null and doc_id is not null")
    linked = join_hot(found, final.select("print", "least"), ["print"], counts=final.select("print", "_n"), rows=found.count())
    linked = linked.withColumn("component_id", F.col("least.doc_id")).withColumn("first", F.struct("doc_id", "h") == F.col("least"))
    alone = flat.where("print is null or doc_id is null").withColumn("component_id", F.col("doc_id")).withColumn("first", F.lit(True))
    columns = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("h").alias("text_hash"), "first"]
    return scratch.finish(linked.select(*columns).unionByName(alone.select(*columns)))
