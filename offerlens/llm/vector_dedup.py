"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are turned onto the principal axes of a bounded sample and dealt into
cells: boxes that halve the sample along whichever leading axis spreads most,
for about ``TILE`` vectors each. The exact bounding box of every cell (leading
coordinates, and the norm of what is left) is one row, so all boxes reach every
worker. A vector is sent to a cell only if its distance to that box admits the
threshold; two tiles meet with just the vectors that may link across. A pair of
tiles is compared by accumulating the leading dimensions first; what is left of a
cosine is at most the product of the two suffix norms, so a pair is dropped as soon
as the partial sum plus that bound stays under the threshold. What remains is
decided by the cosine of the original vectors in double precision. Equal vectors
are one class that carries its count; a cell of more than ``TILE`` classes is split
by hash, and its tiles meet one another.

A tile pair gives counts per vector and the edges of a spanning forest, never
all linked pairs, so a group of m near copies costs rows in proportion to m.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component link with nothing; vectors of different length do not link; rows with a
null id link with nothing and are kept, without a component; rows that repeat an id
count as separate vectors that link by their own values, and equal vectors link
whatever their ids; an empty table gives no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import stream_groups
from .graph import components
from .scratch import Scratch
from .skew import join_hot
from .vectors import matrix, sample, unit, usable, widths

THRESHOLD = 0.95
#: Vectors of a tile; rows of one side compared at once; dimensions of the steps.
TILE, BLOCK, STEPS = 4096, 512, (12, 24)
#: Leading axes that cells are cut along, and cells at most: their boxes go to every worker.
AXES, MAX_CELLS = 12, 4096
#: Slack for single precision.
SLACK = 1e-5


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of 0..n-1 under edges ``u, v``."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new[label]
    return label


def compare(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of unit ``x`` and ``y`` with cosine at least ``threshold``; ``rx``, ``ry`` are turned onto the principal axes."""
    steps = [s for s in STEPS if s < rx.shape[1]]
    fx, fy = rx.astype(np.float32), ry.astype(np.float32)
    tails = [(np.sqrt(np.maximum((rx[:, s:] ** 2).sum(1), 0)).astype(np.float32), np.sqrt(np.maximum((ry[:, s:] ** 2).sum(1), 0)).astype(np.float32)) for s in steps]
    found_i, found_j = [], []
    for a in range(0, len(x), BLOCK):
        b = min(len(x), a + BLOCK)
        if not steps:
            i, j = np.nonzero(np.ones((b - a, len(y)), dtype=bool))
        else:
            part = fx[a:b, :steps[0]] @ fy[:, :steps[0]].T
            part += tails[0][0][a:b, None] * tails[0][1][None, :]
            i, j = np.nonzero(part >= threshold - SLACK)
        if same:
            keep = i + a < j
            i, j = i[keep], j[keep]
        for k in range(1, len(steps)):
            if len(i) > 4 * BLOCK * 64:
                break  # dense: a full product is cheaper than gathered rows
            s = steps[k]
            bound = (fx[a + i, :s] * fy[j, :s]).sum(1) + tails[k][0][a + i] * tails[k][1][j]
            keep = bound >= threshold - SLACK
            i, j = i[keep], j[keep]
        for c in range(0, len(i), 65536):
            p, q = i[c:c + 65536], j[c:c + 65536]
            near = np.einsum("ij,ij->i", x[a + p], y[q]) >= threshold
            found_i.append(a + p[near])
            found_j.append(q[near])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


class Cells:
    """Boxes that halve a sample along its axes, as a tree of cuts, with about ``wanted`` leaves."""

    def __init__(self, lead: np.ndarray, wanted: int):
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.high: list[int] = []
        self.leaves = 0
        self._grow(lead, wanted)

    def _grow(self, rows: np.ndarray, wanted: int) -> int:
        at = len(self.axis)
        self.axis.append(-1)
        self.cut.append(0.0)
        self.high.append(-1)
        axis = int(np.argmax(rows.var(axis=0))) if wanted > 1 and len(rows) > 1 else -1
        if axis >= 0 and (v := np.sort(rows[:, axis]))[0] < v[-1]:
            few = wanted // 2
            cut = v[min(len(v) - 1, max(1, len(v) * few // wanted))]
            below = rows[:, axis] < cut
            if below.any() and not below.all():
                self.axis[at], self.cut[at] = axis, float(cut)
                self._grow(rows[below], few)  # the lower child follows its parent
                self.high[at] = self._grow(rows[~below], wanted - few)
                return at
        self.high[at] = self.leaves
        self.leaves += 1
        return at

    def of(self, lead: np.ndarray) -> np.ndarray:
        """Cell of each row."""
        axis, cut, high = np.asarray(self.axis), np.asarray(self.cut), np.asarray(self.high)
        at = np.zeros(len(lead), dtype=np.int64)
        while len(on := np.flatnonzero(axis[at] >= 0)):
            node = at[on]
            at[on] = np.where(lead[on, axis[node]] < cut[node], node + 1, high[node])
        return high[at]


def lead_of(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors, and the norm of the rest as the last column."""
    lead = x @ turn
    rest = np.sqrt(np.maximum(1 - (lead ** 2).sum(1), 0))
    return np.concatenate([lead, rest[:, None]], axis=1).astype(np.float32)


def admits(lead: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a vector (row) may reach the threshold with some vector of a box (column): the distance of two unit vectors is at least that of their leads and suffix norms."""
    far = np.zeros((len(lead), len(low)), dtype=np.float32)
    for k in range(lead.shape[1]):
        gap = np.maximum(low[None, :, k] - lead[:, None, k], lead[:, None, k] - high[None, :, k])
        np.maximum(gap, 0, out=gap)
        far += gap * gap
    return far <= 2 - 2 * threshold + SLACK


def _mapped(df: DataFrame, schema: pa.Schema, ddl: str, fn, rows: int = 2000) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, rows):
                part = b.slice(a, rows)
                columns = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                columns |= fn(columns["embedding"], columns)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if isinstance(columns[f.name], (list, np.ndarray)) else columns[f.name].cast(f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def tiled(own: DataFrame, axes: np.ndarray, learned: np.ndarray, width: int, threshold: float, scratch: Scratch) -> DataFrame:
    """``class, n, embedding, tile, others``: every vector with its tile and the tiles it may have links in, its own among them."""
    spark, rows = own.sparkSession, own.count()
    turn = np.ascontiguousarray(axes[:AXES].T)
    cells = Cells(learned @ turn, min(MAX_CELLS, -(-rows // TILE)))
    names = [f"x{k}" for k in range(turn.shape[1] + 1)]
    short = dict(own.dtypes)["embedding"] == "array<float>"  # sent as they came: half the bytes
    ddl, vector = ("array<float>", pa.list_(pa.float32())) if short else ("array<double>", pa.list_(pa.float64()))
    kept = [pa.field("class", pa.int64()), pa.field("n", pa.int64()), pa.field("embedding", vector)]
    sent = spark.sparkContext.broadcast((turn, cells))

    def place(embedding: pa.Array, _: dict) -> dict:
        turn, cells = sent.value
        lead = lead_of(unit(matrix(embedding, width)), turn)
        return {"cell": cells.of(lead).astype(np.int32)} | {n: lead[:, k] for k, n in enumerate(names)}

    schema = pa.schema([*kept, pa.field("cell", pa.int32()), *(pa.field(n, pa.float32()) for n in names)])
    placed = scratch.save(_mapped(own.select("class", "n", F.col("embedding").cast(ddl).alias("embedding")), schema,
                                  f"class long, n long, embedding {ddl}, cell int, " + ", ".join(f"{n} float" for n in names), place))
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("_c"), *(f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max))).orderBy("cell").collect()  # at most MAX_CELLS rows
    low, high = (np.asarray([[r[f"{f}_{n}"] for n in names] for r in boxes], dtype=np.float32).reshape(len(boxes), len(names)) for f in ("min", "max"))
    parts = np.asarray([-(-r["_c"] // TILE) for r in boxes], dtype=np.int64)
    base = np.cumsum(parts) - parts
    number = np.zeros(cells.leaves, dtype=np.int64)
    number[[r["cell"] for r in boxes]] = np.arange(len(boxes))
    split = spark.sparkContext.broadcast((low, high, parts, base, number))

    def meet(embedding: pa.Array, columns: dict) -> dict:
        low, high, parts, base, number = split.value
        lead = np.stack([columns[n].to_numpy() for n in names], axis=1)
        cell = number[columns["cell"].to_numpy()]
        may = admits(lead, low, high, threshold)
        may[np.arange(len(cell)), cell] = True
        part = columns["hash"].to_numpy() % parts[cell]
        others = [np.concatenate([np.arange(base[c], base[c] + parts[c]) for c in np.flatnonzero(row)]) for row in may]
        return {"tile": (base[cell] + part), "others": others}

    schema = pa.schema([*kept, pa.field("tile", pa.int64()), pa.field("others", pa.list_(pa.int64()))])
    return _mapped(placed.withColumn("hash", F.abs(F.xxhash64("class") % F.lit(1 << 40))), schema, f"class long, n long, embedding {ddl}, tile long, others array<long>", meet)


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``(vec_id, embedding)``."""
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    takes_part = F.col("vec_id").isNotNull() & usable("embedding")
    keyed = rows.where(takes_part).select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    classes = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    classes = scratch.save(classes.withColumn("class", F.monotonically_increasing_id()))  # written once, so the number stays
    links = None
    for width in widths(classes):
        own = classes.where(F.size("embedding") == width)
        learned = sample(own.select("class", "embedding"), width)
        _, axes = np.linalg.eigh(learned.T @ learned / len(learned))
        axes = axes.T[::-1].copy()
        got = scratch.save(_tile_pairs(tiled(own, axes, learned, width, threshold, scratch), axes, width, threshold))
        links = got if links is None else links.unionByName(got)
    if links is None:
        links = spark.createDataFrame([], "class long, links long, root long")
    per_class = links.groupBy("class").agg(F.sum("links").alias("links"))
    edges = links.where("class <> root").select(F.col("class").alias("u"), F.col("root").alias("v"))
    comps = components(edges, scratch).select(F.col("id").alias("class"), "component")
    comps = scratch.save(comps.join(classes.select("class", "least"), "class"))
    least = comps.groupBy("component").agg(F.min("least").alias("component_id"))
    comps = join_hot(comps.select("class", "component"), least, ["component"]).select("class", "component_id")
    known = classes.select("class", "h1", "h2", "n", "least").join(per_class, "class", "left").join(comps, "class", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    known = scratch.save(known)
    of = join_hot(keyed.select("vec_id", "h1", "h2"), known, ["h1", "h2"], counts=classes.select("h1", "h2", F.col("n").alias("_n")), rows=keyed.count())
    rest = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = of.select("vec_id", "n_links", "component_id").unionByName(rest)
    return scratch.finish(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _tile_pairs(tiles: DataFrame, axes: np.ndarray, width: int, threshold: float) -> DataFrame:
    """``class, links, root`` from the pairs of tiles that meet: linked vectors counted with their copies, and a spanning forest's edges."""
    shared = tiles.sparkSession.sparkContext.broadcast(axes)
    sent = tiles.select("tile", "class", "n", "embedding", F.explode("others").alias("other")).select(
        F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "class", "n", "embedding")

    def run(starts: np.ndarray, p: pa.ChunkedArray, q: pa.ChunkedArray, tile: pa.ChunkedArray, embedding: pa.ChunkedArray, n: pa.ChunkedArray, **c: pa.ChunkedArray) -> dict:
        ids, counts, side = c["class"].to_numpy(), n.to_numpy(), tile.to_numpy()
        low, top = p.to_numpy(), q.to_numpy()
        turn = shared.value.T
        out_id, out_links, out_root = [], [], []
        for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
            left = np.flatnonzero(side[a:b] == low[a])
            right = np.flatnonzero(side[a:b] != low[a])
            same = low[a] == top[a]
            if same:
                right = left
            if not len(left) or not len(right):
                continue
            x = unit(matrix(embedding.slice(a, b - a), width))
            r = x @ turn
            if not same and not _may_meet(r[left], r[right], threshold):
                continue
            i, j = compare(x[left], x[right], r[left], r[right], threshold, same)
            if not len(i):
                continue
            i, j = left[i], right[j]
            links = np.bincount(i, weights=counts[a:b][j], minlength=b - a) + np.bincount(j, weights=counts[a:b][i], minlength=b - a)
            root = forest(i, j, b - a)
            least = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(least, root, ids[a:b])
            hit = np.flatnonzero(links)
            out_id.append(ids[a:b][hit])
            out_links.append(links[hit].astype(np.int64))
            out_root.append(least[root[hit]])
        flat = lambda parts: np.concatenate(parts) if parts else []
        return {"class": flat(out_id), "links": flat(out_links), "root": flat(out_root)}

    return stream_groups(sent, ["p", "q"], "class long, links long, root long", run)


def _may_meet(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """False if the bounding boxes of two sets of unit vectors are too far apart for the threshold."""
    gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
    return bool((gap ** 2).sum() <= 2 - 2 * threshold + 1e-9)
