"""Shortest-pack-first packing over the length histogram.

Documents become pieces of at most ``width`` ids. Only the histogram of piece
lengths (at most ``width`` rows) reaches the driver, where lengths are placed
longest first and counts move between packing patterns. The patterns then go
back to the pieces by rank: the r-th piece of a length takes the r-th slot that
the patterns hold for that length. Piece text never moves; the one shuffle
carries a few integers per piece.

Defined results: a null text packs as an empty one (the end id alone); repeated
rows are packed once each; an empty table gives no rows; further columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .batches import held, map_columns
from .scratch import Scratch

WIDTH, END_ID = 4096, 2
#: Distinct words a worker remembers before it starts anew; words encoded in one call.
MEMO_WORDS, TOGETHER = 500_000, 10_000
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Little-endian unsigned 32-bit ids of each word, in ASCII lower case, encoded when first met.

    The tokenizer drops white space, lowers case and never joins a letter to what
    is not one, so a document's ids are its words' ids in order, and a word's are
    those of its letters and of the marks behind them. Words of letters only
    have exactly one id that ends a word, at their end: many are encoded in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.ends = np.asarray([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(self.tok.get_vocab_size())])

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        got = self[word] = self.whole(word.decode())
        return got

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > MEMO_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        letters, marked = {}, []
        for w in new:
            core = w.rstrip(_MARKS)
            text = core.decode()
            if text.isalpha():
                if core not in self:
                    letters[core] = text
                if len(core) < len(w):
                    marked.append((w, core))
        self._together(list(letters), list(letters.values()))
        for w, core in marked:
            self[w] = self[core] + self[w[len(core):]]

    def _together(self, keys: list[bytes], texts: list[str]) -> None:
        """Encode words in one call where that gives one word end for each; a part that holds a word with more ends is halved."""
        parts = [(a, min(a + TOGETHER, len(keys))) for a in range(0, len(keys), TOGETHER)]
        while parts:
            a, b = parts.pop()
            ids = np.asarray(self.tok.encode(" ".join(texts[a:b]), add_special_tokens=False).ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == b - a:
                data = ids.tobytes()
                self.update(zip(keys[a:b], (data[i:j] for i, j in zip([0, *cuts], cuts, strict=False)), strict=True))
            elif b - a > 1:
                parts += [(a, (a + b) // 2), ((a + b) // 2, b)]
            else:
                self[keys[a]] = ids.tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        words = [(t or "").encode().lower().split() for t in texts]
        self.learn(set().union(*words))
        # strings of special tokens count as such only in the whole text
        return [self.whole(t) if t and "<|" in t else b"".join(map(self.__getitem__, w)) for t, w in zip(texts, words, strict=True)]


def word_ids(path: str) -> WordIds:
    return held("packing " + path, lambda: WordIds(path))


def cut(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``width`` ids: one row of ``PIECES`` each."""
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def run(doc_id: list, text: list) -> dict:
        ids, rows = word_ids(path), []
        for doc, data in zip(doc_id, ids.encode_all(text), strict=True):
            data += tail
            n = len(data) // 4
            for at in range(0, n, width):
                part = data[4 * at:4 * (at + width)]
                rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
        return dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows, strict=True), strict=True))

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), PIECES, run)


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)`` per packing pattern.

    Lengths are taken longest first. The pieces of a length go to the patterns
    with the most room (the shortest packs); what a pattern cannot take opens
    new sequences.
    """
    room: list[tuple[int, int]] = []  # heap of (-free, index)
    patterns: list[list] = []  # [count, lengths, free]

    def put(count: int, lengths: tuple[int, ...], free: int) -> None:
        patterns.append([count, lengths, free])
        if free:
            heapq.heappush(room, (-free, len(patterns) - 1))

    for length in sorted((k for k, v in histogram.items() if v > 0), reverse=True):
        left = histogram[length]
        if length > width:
            raise ValueError("a piece is longer than a sequence")
        while left and room and -room[0][0] >= length:
            at = heapq.heappop(room)[1]
            count, lengths, free = patterns[at]
            use = min(count, left)
            patterns[at][0] -= use
            if patterns[at][0]:
                heapq.heappush(room, (-free, at))
            put(use, (*lengths, length), free - length)
            left -= use
        if left:  # nothing has room: each new sequence is the shortest pack until it is full
            each = width // length
            full, rest = divmod(left, each)
            if full:
                put(full, (length,) * each, width - each * length)
            if rest:
                put(1, (length,) * rest, width - rest * length)
    return [(c, p) for c, p, _ in patterns if c]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: one row per slot of a pattern, sorted by (length, rank)."""
    length, count, base, offset, per = [], [], [], [], []
    at = 0
    for n, lengths in patterns:
        where = 0
        for x in lengths:
            length.append(x)
            count.append(n)
            base.append(at)
            offset.append(where)
            per.append(len(lengths))
            where += x
        at += n
    ln = np.asarray(length, dtype=np.int64)
    order = np.argsort(ln, kind="stable")
    ln, n = ln[order], np.asarray(count, dtype=np.int64)[order]
    total = np.cumsum(n) - n
    first = np.searchsorted(ln, ln, side="left")
    return {"length": ln, "from": total - total[first] if len(ln) else total, "base": np.asarray(base, dtype=np.int64)[order],
            "offset": np.asarray(offset, dtype=np.int64)[order]}


def pack(docs: DataFrame, path: str, width: int = WIDTH, end_id: int = END_ID, rank_rows: int = 200_000) -> DataFrame:
    """``PIECES`` with ``sequence_id`` and ``offset``, gapless in each sequence.

    ``rank_rows`` sizes the salt that splits a frequent length when ranks are
    taken: about that many pieces of a length share one sort.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.save(cut(docs, path, width, end_id))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = slots(shortest_pack_first(histogram, width))
    parts = max(1, -(-max(histogram.values(), default=1) // rank_rows))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)))
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start")) - 1)
    if parts > 1:
        n = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
        before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.join(n.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")),
                             ["length", "salt"]).withColumn("r", F.col("r") + F.col("before"))
    key = where["length"] * (1 << 44) + where["from"]

    def place(r: list, length: list, **kept: list) -> dict:
        rank, size = np.asarray(r, dtype=np.int64), np.asarray(length, dtype=np.int64)
        at = np.searchsorted(key, size * (1 << 44) + rank, side="right") - 1
        return kept | {"length": size, "sequence_id": where["base"][at] + rank - where["from"][at], "offset": where["offset"][at]}

    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("r").cast("long").alias("r"))
    return scratch.finish(map_columns(ranked, PIECES + ", sequence_id long, offset long", place, rows=100_000))
