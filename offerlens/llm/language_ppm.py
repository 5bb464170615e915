"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts (up to ``ORDER`` bytes)
with escape probabilities by method C: in a context seen ``n`` times with ``q``
distinct followers, a follower seen ``c`` times costs ``-log2(c / (n + q))`` and
leaving for the next shorter context costs ``-log2(q / (n + q))``; what the longer
context has seen is excluded from the shorter one, so the code lengths are those
of a proper distribution. Statistics are frozen after training. A text is coded
whole under every language, and the shortest code names it.

Training reads a bounded sample of labelled texts (``max_docs`` a language);
scoring reads every byte of every text. Letters are coded in lower case.

Defined results: null, empty or letterless texts are ``und`` with score 0;
equal code lengths go to the language first in order of name; with no labelled
text every row is ``und``.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batches import map_columns
from .sampling import bounded, within_bytes

ORDER = 3
MAX_DOCS = 800
#: Bytes of text that one language's trees are made from at most.
MAX_LANG_BYTES = 4 << 20
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grams:
    """A set of byte strings of one length as a hash table that numpy can probe."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint32)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        self.depth = 0
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(self.keys)
        while len(left):  # linear probing: each round places what finds its cell free
            self.depth += 1
            free = self.table[at] < 0
            slot, who = np.unique(at[free], return_index=True)
            self.table[slot] = left[free][who]
            lost = self.table[at] != left
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self._home(keys)
        row = self.table[at]
        hit = (row >= 0) & (self.keys[row] == keys)
        out = np.where(hit, row, -1).astype(np.int32)
        todo = np.flatnonzero(~hit & (row >= 0))
        for _ in range(self.depth - 1):
            if not len(todo):
                break
            at = (at[todo] + 1 if at.shape == out.shape else at + 1) & ((1 << self.bits) - 1)
            row = self.table[at]
            hit = (row >= 0) & (self.keys[row] == keys[todo])
            out[todo[hit]] = row[hit]
            on = ~hit & (row >= 0)
            todo, at = todo[on], at[on]
        return out


def packed(buf: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 0..order, the integer of the k+1 bytes that end at each place (zeros before the start)."""
    out = [buf.astype(np.uint32)]
    for k in range(1, order + 1):
        before = np.zeros(len(buf), dtype=np.uint32)
        before[k:] = out[0][:-k] if k < len(buf) else before[k:]
        out.append(out[-1] | (before << np.uint32(8 * k)))
    return out


def buffer(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower case, each after ``order`` zero bytes; and where each begins in it."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    starts = np.cumsum([0, *(len(r) + order for r in raw)])
    return np.frombuffer(bytes(order).join([b"", *raw]) if raw else b"", dtype=np.uint8), starts


class Ppm:
    """Frozen context trees of several languages over one shared set of byte strings."""

    def __init__(self, names: list[str], samples: dict[str, list[str]], order: int = ORDER):
        self.names, self.order = names, order
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for name in names:
            buf, starts = buffer(samples[name], order)
            inside = np.ones(len(buf), dtype=bool)
            for k in range(order):  # the zero bytes before a text are contexts, never coded
                inside[starts[:-1] + k] = False
            keys = packed(buf, order)
            counts.append([np.unique(k[inside], return_counts=True) for k in keys])
        self.grams, self.cost, self.leave = [], [], []
        n_lang = len(names)
        for k in range(order + 1):
            union = np.unique(np.concatenate([c[k][0] for c in counts]) if counts else np.zeros(0, np.uint32))
            self.grams.append(Grams(union))
            self.cost.append(np.zeros((len(union), n_lang), dtype=np.float32))
        # leave[k]: by row of grams[k-1] (the context's bytes), bits to leave it for the next shorter context
        self.root_leave = np.zeros(n_lang)
        exact: list[np.ndarray] = []
        for k in range(order + 1):
            union = self.grams[k].keys
            cost = np.zeros((len(union), n_lang))
            ctx = union >> np.uint32(8)
            # contexts are found in the order below; those of order k at text starts hold zero bytes
            if k:
                cset, cinv = np.unique(ctx, return_inverse=True)
            else:
                cset, cinv = np.zeros(1, np.uint32), np.zeros(len(union), dtype=np.int64)
            leave = np.zeros((len(cset), n_lang))
            shorter = union & np.uint32((1 << (8 * k)) - 1) if k else None
            below = self._cost(shorter, k - 1, exact) if k else np.full((len(union), n_lang), 8.0)
            for j in range(n_lang):
                key, cnt = counts[j][k]
                row = np.searchsorted(union, key)
                c = np.zeros(len(union))
                c[row] = cnt
                n = np.bincount(cinv, weights=c, minlength=len(cset))
                q = np.bincount(cinv, weights=c > 0, minlength=len(cset))
                seen_below = np.bincount(cinv, weights=np.where(c > 0, np.exp2(-below[:, j]), 0), minlength=len(cset))
                rest = np.maximum(1 - seen_below, 1e-6)
                with np.errstate(divide="ignore", invalid="ignore"):
                    esc = np.where(n > 0, -np.log2(q / (n + q)) + np.log2(rest), 0.0)
                    own = -np.log2(c / (n + q)[cinv])
                leave[:, j] = esc
                cost[:, j] = np.where(c > 0, own, esc[cinv] + below[:, j])
            exact.append(cost)
            self.cost[k] = cost.astype(np.float32)
            self.leave.append((Grams(cset) if k else None, leave.astype(np.float32)))

    def _cost(self, keys: np.ndarray, k: int, exact: list[np.ndarray] | None = None) -> np.ndarray:
        """Bits of the last byte of each key of k+1 bytes after the others, by language."""
        costs = self.cost if exact is None else exact
        row = self.grams[k].find(keys)
        out = costs[k][np.maximum(row, 0)] if len(costs[k]) else np.zeros((len(keys), len(self.names)))
        miss = np.flatnonzero(row < 0)
        if len(miss):
            if k:
                ctx, leave = self.leave[k]
                at = ctx.find(keys[miss] >> np.uint32(8))
                extra = np.where((at >= 0)[:, None], leave[np.maximum(at, 0)], 0) if len(leave) else 0
                out[miss] = extra + self._cost(keys[miss] & np.uint32((1 << (8 * k)) - 1), k - 1, exact)
            else:
                out[miss] = self.leave[0][1][0] + 8.0 if len(self.leave[0][1]) else 8.0
        return out

    def bits(self, texts: list[str], block: int = 1 << 20) -> np.ndarray:
        """Code length of each text under each language."""
        buf, starts = buffer(texts, self.order)
        out = np.zeros((len(texts), len(self.names)))
        keys = packed(buf, self.order)[-1] if len(buf) else np.zeros(0, np.uint32)
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        skip = np.zeros(len(buf), dtype=bool)
        for k in range(self.order):
            skip[starts[:-1] + k] = True
        for a in range(0, len(buf), block):
            part = ~skip[a:a + block]
            cost = self._cost(keys[a:a + block][part], self.order)
            where = doc[a:a + block][part]
            if len(where):
                low, high = where[0], where[-1] + 1
                for j in range(len(self.names)):
                    out[low:high, j] += np.bincount(where - low, weights=cost[:, j], minlength=high - low)
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ok = np.asarray([bool(t) and bool(_LETTER.search(t)) for t in texts], dtype=bool)
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if ok.any() and self.names:
            at = np.flatnonzero(ok)
            b = self.bits([texts[i] for i in at])
            best = b.argmin(1)
            score[at] = 1 / np.exp2(-np.minimum(b - b.min(1, keepdims=True), 1000)).sum(1)
            for i, k in zip(at, best, strict=True):
                names[i] = self.names[k]
        return names, score


def fit(labelled: DataFrame, max_docs: int = MAX_DOCS, order: int = ORDER) -> Ppm:
    """Context trees from ``(doc_id, text, lang)``; of each language at most ``max_docs`` texts and ``MAX_LANG_BYTES`` are read."""
    rows = bounded(labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang"), "doc_id", max_docs, "lang")
    rows = within_bytes(rows, "doc_id", "text", "lang", MAX_LANG_BYTES)
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Ppm(sorted(samples), samples, order)


def identify(docs: DataFrame, model: Ppm) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row; the score is the posterior of the shortest code."""

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(doc_id: list, text: list) -> dict:
        names, score = shared.value.classify(text)
        return {"doc_id": doc_id, "lang_pred": names, "score": score}

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, lang_pred string, score double", run)
