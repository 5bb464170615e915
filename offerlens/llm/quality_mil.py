"""Quality score by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its bytes
(transitions between character classes) and its words (repeats, lengths); a
learned layer maps that to a hidden vector; gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages; a logistic unit
scores the weighted sum. Only document labels train it: attention finds the
passages that decide.

Scoring reads whole texts. Fitting reads a bounded sample of labelled rows
(``max_docs``, and ``sampling.MAX_BYTES`` of text), whole texts too.

Defined results: null and empty texts are one empty passage and get that bag's
score; repeated rows are scored each; with no labelled row every score is 0.5.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batches import map_columns
from .sampling import labelled_texts

MAX_DOCS = 6000
PASSAGE_WORDS = 64
#: Longest run of bytes in a passage; a longer one is cut, as a text may hold no white space.
PASSAGE_BYTES = 2048
#: Texts whose features are computed at once.
FIT_ROWS = 200
CLASSES = 14
N_EXTRA = 8
N_FEATURES = CLASSES * CLASSES + N_EXTRA


def _classes() -> np.ndarray:
    lut = np.full(256, 13, dtype=np.uint8)
    for i, group in enumerate((b" \t", b"\n\r\x0b\x0c", b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"AEIOUY", b"BCDFGHJKLMNPQRSTVWXZ",
                               b"0123456789", b".,;:?", b"!", b"'\"()[]-", b"|/\\<>{}_=+", b"#$%&*@^~`")):
        lut[list(group)] = i
    lut[128:] = 12
    return lut


_LUT = _classes()


def passages(text: str | None) -> list[tuple[bytes, int, int, int]]:
    """Bytes, words, distinct words and word repeats in a row of each passage of a text; at least one."""
    words = (text or "").encode("utf-8", "replace").split(b" ")
    out = []
    for a in range(0, len(words), PASSAGE_WORDS):
        part = words[a:a + PASSAGE_WORDS]
        raw = b" ".join(part)
        again = sum(map(bytes.__eq__, part, part[1:]))
        for k in range(0, max(len(raw), 1), PASSAGE_BYTES):
            out.append((raw[k:k + PASSAGE_BYTES], len(part), len(set(part)), again))
    return out


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Raw passage features and the text each passage is of."""
    bags = [passages(t) for t in texts]
    flat = [p for bag in bags for p in bag]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    raw = [p[0] for p in flat]
    size = np.asarray([len(r) for r in raw], dtype=np.int64)
    cls = _LUT[np.frombuffer(b"".join(raw), dtype=np.uint8)].astype(np.int64)
    at = np.repeat(np.arange(len(raw)), size)
    pair = cls[:-1] * CLASSES + cls[1:]
    same = at[:-1] == at[1:]
    grid = np.bincount(at[:-1][same] * (CLASSES * CLASSES) + pair[same], minlength=len(raw) * CLASSES * CLASSES)
    grid = grid.reshape(len(raw), CLASSES * CLASSES).astype(np.float32)
    n, distinct, again = (np.asarray([p[k] for p in flat], dtype=np.float32) for k in (1, 2, 3))
    squeezed = np.asarray([len(zlib.compress(r, 1)) for r in raw], dtype=np.float32)
    length = np.maximum(size, 1).astype(np.float32)
    bag_passages = np.bincount(owner, minlength=len(bags)).astype(np.float32)[owner]
    extra = np.stack([np.log1p(length), n / PASSAGE_WORDS, distinct / np.maximum(n, 1), again / np.maximum(n, 1), squeezed / (length + 20),
                      length / np.maximum(n, 1) / 10, np.log1p(bag_passages), (size == 0).astype(np.float32)], axis=1)
    return np.concatenate([np.sqrt(grid / length[:, None]), extra], axis=1), owner


class Mil:
    """Weights of the encoder, of the gated attention and of the score."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"W": g(N_FEATURES, hidden), "b": np.zeros(hidden, np.float32), "V": g(hidden, gate), "U": g(hidden, gate),
                  "a": g(gate), "c": g(hidden), "c0": np.zeros(1, np.float32)}
        self.mean, self.scale, self.fitted = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), False

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["a"]
        top = np.full(bags, -np.inf, np.float32)
        np.maximum.at(top, owner, e)
        ex = np.exp(e - top[owner])
        att = ex / np.bincount(owner, weights=ex, minlength=bags)[owner]
        first = np.searchsorted(owner, np.arange(bags))
        z = np.add.reduceat(h * att[:, None], first, axis=0)
        return {"h": h, "t": t, "s": s, "att": att, "z": z, "first": first, "p": 1 / (1 + np.exp(-(z @ w["c"] + w["c0"])))}

    def step(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, state: dict, rate: float, decay: float) -> None:
        """One Adam step on the mean logistic loss of a batch of bags."""
        w, f = self.w, self.forward(x, owner, len(y))
        dz0 = ((f["p"] - y) / len(y)).astype(np.float32)
        dz = dz0[:, None] * w["c"]
        dh = dz[owner] * f["att"][:, None]
        datt = (dz[owner] * f["h"]).sum(1)
        mean = np.add.reduceat(datt * f["att"], f["first"])[owner]
        de = f["att"] * (datt - mean)
        dgate = de[:, None] * w["a"]
        dt, ds = dgate * f["s"] * (1 - f["t"] ** 2), dgate * f["t"] * f["s"] * (1 - f["s"])
        dh = dh + dt @ w["V"].T + ds @ w["U"].T
        dpre = dh * (1 - f["h"] ** 2)
        grads = {"W": x.T @ dpre, "b": dpre.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "a": (f["t"] * f["s"]).T @ de,
                 "c": f["z"].T @ dz0, "c0": dz0.sum(keepdims=True)}
        state["n"] = state.get("n", 0) + 1
        for k, g in grads.items():
            g = g + (decay * w[k] if g.ndim > 1 else 0)
            m = state["m" + k] = 0.9 * state.get("m" + k, 0) + 0.1 * g
            v = state["v" + k] = 0.999 * state.get("v" + k, 0) + 0.001 * g * g
            w[k] = (w[k] - rate * (m / (1 - 0.9 ** state["n"])) / (np.sqrt(v / (1 - 0.999 ** state["n"])) + 1e-8)).astype(np.float32)

    def fit(self, texts: list[str | None], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 4e-3, decay: float = 1e-4, seed: int = 5) -> Mil:
        if not len(texts):
            return self
        parts = [features(texts[a:a + FIT_ROWS]) for a in range(0, len(texts), FIT_ROWS)]
        owner = np.concatenate([own + k * FIT_ROWS for k, (_, own) in enumerate(parts)])
        x = np.concatenate([p for p, _ in parts])
        del parts
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        x -= self.mean
        x /= self.scale
        first = np.searchsorted(owner, np.arange(len(texts) + 1))
        rng, state = np.random.default_rng(seed), {}
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), batch):
                take = order[a:a + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in take])
                own = np.repeat(np.arange(len(take)), first[take + 1] - first[take])
                self.step(x[rows], own, y[take], state, rate * (1 - epoch / epochs) + 1e-4, decay)
        self.fitted = True
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        if not self.fitted:
            return np.full(len(texts), 0.5)
        x, owner = features(texts)
        return self.forward((x - self.mean) / self.scale, owner, len(texts))["p"].astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Mil:
    """Weights from ``labels`` (``doc_id, quality``) and the texts of those documents; see ``labelled_texts``."""
    rows = labelled_texts(docs, labels, "quality", max_docs)
    return Mil().fit([t for t, _ in rows], np.asarray([y for _, y in rows], dtype=np.float32))


def score(docs: DataFrame, model: Mil) -> DataFrame:
    """``doc_id, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(doc_id: list, text: list) -> dict:
        return {"doc_id": doc_id, "score": shared.value.score(text)}

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, score double", run, rows=250)
