"""Toxicity severity by cumulative-link ordinal regression.

``P(grade <= k) = sigmoid(theta_k - w . x)``: one weight vector is shared by all
ordered thresholds. Features are sparse: for each word of a text, and for its
beginnings of three to five letters, so that inflected forms share evidence, that
it occurs and the logarithm of how often. Fitting keeps the features in whose texts a
grade has several times its usual odds, then minimises the model's negative log
likelihood: a text of grade k costs ``-log(P(grade <= k) - P(grade <= k - 1))``.
Weights take accelerated proximal gradient steps with an L1 penalty, which leaves
few of them, and thresholds damped Newton steps, in turn; both keep the problem's
convexity, so the order of steps does not matter for where they end. The result
is the expected severity and the probability of each grade from 1 on.

Where labels are binary, grades come from how often a toxic text uses words
that the labels themselves single out (``grades``).

Fitting reads a bounded sample of labelled rows (``max_docs``, and
``sampling.MAX_BYTES`` of text); scoring reads every text whole.

Defined results: null, empty and wordless texts score as a text without features;
repeated rows are scored each; equally likely grades give the lower one; with no
labelled row every severity is 0.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .batches import map_columns
from .sampling import labelled_texts

MAX_DOCS = 8000
#: Texts a feature must occur in, standard errors by which it must raise the share with a grade, and the factor on its odds.
MIN_TEXTS, MIN_Z, MIN_ODDS = 5, 5.5, 4.0
#: Further occurrences of singled-out words that each raise a toxic text's grade by one.
STEPS = (3, 6)
#: Weight of the penalty on the sum of weights; turns of weights and thresholds, and steps of weights in a turn.
L1, TURNS, INNER, ENOUGH = 5e-5, 200, 20, 1e-3
#: Texts whose features are counted at once.
BLOCK = 500
MEMO_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def parts(word: str) -> list[str]:
    """Features of a word: itself and its beginnings."""
    return [word, *("^" + word[:k] for k in (3, 4, 5) if len(word) >= k)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Bags:
    """Words of some texts, each word stored once: counts by (text, word)."""

    def __init__(self, texts: list[str | None]):
        self.word: dict[str, int] = {}
        row, col, count = [], [], []
        for i, t in enumerate(texts):
            bag = Counter(words(t))
            row.append(np.full(len(bag), i, dtype=np.int32))
            col.append(np.fromiter((self.word.setdefault(w, len(self.word)) for w in bag), dtype=np.int32, count=len(bag)))
            count.append(np.fromiter(bag.values(), dtype=np.int32, count=len(bag)))
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        self.n, self.row, self.col, self.count = len(texts), flat(row), flat(col), flat(count)

    def select(self, hit: np.ndarray) -> list[str]:
        """Features that raise the share of texts with ``hit`` enough, by the texts that hold them."""
        index: dict[str, int] = {}
        of = [[index.setdefault(p, len(index)) for p in parts(w)] for w in self.word]
        size = np.asarray([len(f) for f in of], dtype=np.int64)
        flat = np.asarray([f for fs in of for f in fs], dtype=np.int64)
        del of
        start, m = np.cumsum(size) - size, max(1, len(index))
        total, with_hit = np.zeros(m), np.zeros(m)
        cuts = np.searchsorted(self.row, np.arange(0, self.n + BLOCK, BLOCK))
        for a, b in zip(cuts, cuts[1:], strict=False):  # all features of all texts at once would not fit
            row, col = self.row[a:b], self.col[a:b]
            times = size[col]
            at = np.repeat(start[col] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            both = np.unique(np.repeat(row.astype(np.int64), times) * m + flat[at])
            total += np.bincount(both % m, minlength=m)
            with_hit += np.bincount(both % m, weights=hit[both // m], minlength=m)
        share = hit.mean()
        some = np.maximum(total, 1)
        rises = with_hit / some - share > MIN_Z * np.sqrt(share * (1 - share) / some)
        keep = (total >= MIN_TEXTS) & rises & (with_hit >= MIN_ODDS * share / (1 - share) * (total - with_hit))
        return sorted(f for f, k in index.items() if keep[k])

    def counts(self, names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text, feature, occurrences)`` of the named features."""
        place = {f: i for i, f in enumerate(names)}
        of = [[place[p] for p in parts(w) if p in place] for w in self.word]
        size = np.asarray([len(f) for f in of], dtype=np.int64)
        flat = np.asarray([f for fs in of for f in fs], dtype=np.int64)
        start, m = np.cumsum(size) - size, max(1, len(names))
        live = size[self.col] > 0
        row, col, count = self.row[live], self.col[live], self.count[live]
        times = size[col]
        at = np.repeat(start[col] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        both, back = np.unique(np.repeat(row.astype(np.int64), times) * m + flat[at], return_inverse=True)
        return both // m, both % m, np.bincount(back, weights=np.repeat(count, times), minlength=len(both))


def likelihood(theta: np.ndarray, s: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of grades at scores ``s``; its gradients by score and by threshold; its Hessian by threshold."""
    n, k = len(s), len(theta)
    edges = np.concatenate([[-np.inf], theta, [np.inf]])
    high, low = edges[grade + 1] - s, edges[grade] - s
    top, bottom = np.where(np.isinf(high), 1.0, _sigmoid(high)), np.where(np.isinf(low), 0.0, _sigmoid(low))
    p = np.maximum(top - bottom, 1e-12)
    slope_top, slope_bottom = top * (1 - top), bottom * (1 - bottom)
    by_score = (1 - top - bottom) / n
    by_theta = (np.bincount(grade, weights=-slope_top / p, minlength=k + 1)[:k] + np.bincount(grade, weights=slope_bottom / p, minlength=k + 1)[1:]) / n
    bend_top, bend_bottom = slope_top * (1 - 2 * top), slope_bottom * (1 - 2 * bottom)
    hess = np.zeros((k, k))
    own = np.bincount(grade, weights=(slope_top / p) ** 2 - bend_top / p, minlength=k + 1)[:k] + np.bincount(grade, weights=(slope_bottom / p) ** 2 + bend_bottom / p, minlength=k + 1)[1:]
    next_ = np.bincount(grade, weights=-slope_top * slope_bottom / p**2, minlength=k + 1)
    hess[np.arange(k), np.arange(k)] = own / n
    for j in range(1, k):
        hess[j - 1, j] = hess[j, j - 1] = next_[j] / n
    return float(-np.log(p).mean()), by_score, by_theta, hess


def _move_thresholds(theta: np.ndarray, s: np.ndarray, grade: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Damped Newton steps that keep the order and never raise the loss."""
    for _ in range(rounds):
        loss, _, g, h = likelihood(theta, s, grade)
        step = np.linalg.solve(h + 1e-9 * np.eye(len(theta)), g)
        for half in range(30):
            new = theta - step * 0.5**half
            if (np.diff(new) > 0).all() and likelihood(new, s, grade)[0] <= loss:
                theta = new
                break
        else:
            break
    return theta


class Ordinal:
    """Thresholds and the weights of the features that were kept."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, 2))
        self.theta = np.zeros(0)
        self._memo: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}}

    def _of(self, word: str) -> tuple[int, ...]:
        got = self._memo.get(word)
        if got is None:
            if len(self._memo) >= MEMO_WORDS:
                self._memo.clear()
            got = self._memo[word] = tuple(self.index[p] for p in parts(word) if p in self.index)
        return got

    def score(self, text: str | None) -> float:
        """``w . x`` of a text."""
        n: dict[int, int] = {}
        for word, times in Counter(words(text)).items():
            for f in self._of(word):
                n[f] = n.get(f, 0) + times
        return sum(self.weight[f, 0] + self.weight[f, 1] * np.log2(n[f]) for f in sorted(n))

    def fit(self, bags: Bags, grade: np.ndarray, names: list[str] | None = None) -> Ordinal:
        """Fit on ``names`` (or the features that ``select`` gives) until a turn lowers the loss by less than ``ENOUGH`` of it."""
        grade = np.unique(np.asarray(grade, dtype=np.int64), return_inverse=True)[1]  # grades that no text has are left out
        levels = int(grade.max(initial=0))
        if not bags.n or levels == 0:
            return self
        names = bags.select(grade > 0) if names is None else names
        r, c, count = bags.counts(names)
        again = count > 1
        n, m = bags.n, len(names)
        r, c = np.concatenate([r, r[again]]), np.concatenate([c, c[again] + m])
        x = np.concatenate([np.ones(len(count)), np.log2(count[again])])
        times = lambda v: np.bincount(r, weights=x * v[c], minlength=n)
        back = lambda e: np.bincount(c, weights=x * e[r], minlength=2 * m)
        under = np.clip(np.cumsum(np.bincount(grade, minlength=levels + 1))[:levels] / n, 1e-4, 1 - 1e-4)
        theta, w = np.log(under / (1 - under)), np.zeros(2 * m)
        step = 1 / np.maximum(0.5 * back(times(np.ones(2 * m))) / n, 1e-9)  # curvature by score is at most 1/2
        last = np.inf
        for _ in range(TURNS):
            v, moment = w, 1.0
            for _ in range(INNER):
                new = np.maximum(v - step * (back(likelihood(theta, times(v), grade)[1]) + L1), 0)  # a kept feature can only raise severity
                after = (1 + np.sqrt(1 + 4 * moment**2)) / 2
                v, w, moment = new + (moment - 1) / after * (new - w), new, after
            s = times(w)
            theta = _move_thresholds(theta, s, grade)
            loss = likelihood(theta, s, grade)[0] + L1 * w.sum()
            if last - loss < ENOUGH * loss:
                break
            last = loss
        pair = w.reshape(2, m).T
        used = np.flatnonzero(pair.any(axis=1))
        self.index = {names[k]: i for i, k in enumerate(used)}
        self.weight, self.theta, self._memo = pair[used], theta, {}
        return self

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """``P(grade > k)`` for each threshold k, by text."""
        if not len(self.theta):
            return np.zeros((len(texts), 1))
        s = np.asarray([self.score(t) for t in texts], dtype=np.float64)
        return 1 - _sigmoid(self.theta[None, :] - s[:, None])


def grades(bags: Bags, toxic: np.ndarray, names: list[str] | None = None) -> np.ndarray:
    """Severity 0 to ``len(STEPS) + 1`` from binary labels: by how many of its words the labels single out."""
    toxic = np.asarray(toxic, dtype=np.int64)
    first = Ordinal().fit(bags, toxic, names)
    strong = set(np.flatnonzero(first.weight[:, 0] > 0.5 * first.weight[:, 0].max(initial=0)).tolist())
    counts = np.asarray([not strong.isdisjoint(first._of(w)) for w in bags.word], dtype=bool)
    uses = np.bincount(bags.row, weights=bags.count * counts[bags.col], minlength=bags.n) if len(bags.row) else np.zeros(bags.n)
    return np.where(toxic > 0, 1 + sum((uses >= s).astype(np.int64) for s in STEPS), 0)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Ordinal:
    """A model from ``labels`` (``doc_id, toxic``) and the texts of those documents; see ``labelled_texts``."""
    rows = labelled_texts(docs, labels, "toxic", max_docs)
    bags, toxic = Bags([t for t, _ in rows]), np.asarray([y for _, y in rows], dtype=np.int64)
    if not toxic.any():
        return Ordinal()
    names = bags.select(toxic > 0)
    return Ordinal().fit(bags, grades(bags, toxic, names), names)


def severity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """``doc_id, expected_severity, grade, p_toxic`` of every row; ``grade`` is the most likely one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(doc_id: list, text: list) -> dict:
        above = shared.value.probabilities(text)
        each = -np.diff(np.concatenate([np.ones((len(text), 1)), above, np.zeros((len(text), 1))], axis=1), axis=1)
        return {"doc_id": doc_id, "expected_severity": above.sum(1), "grade": each.argmax(1).astype(np.int32), "p_toxic": above[:, 0]}

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, expected_severity double, grade int, p_toxic double", run)
