"""Sets of word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from .batches import held

WORDS = 5
#: Distinct words a worker remembers before it starts anew.
MEMO_WORDS = 250_000
_ODD = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _memo() -> _WordHash:
    return held("shingles", _WordHash)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the runs of five words of a text.

    Words are runs of other bytes than space and tab to carriage return, A-Z in
    lower case. A text of one to four words is one shingle; without words the
    set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_memo().__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        return mixed((h * _ODD[:len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    acc = h[:n] * _ODD[0]
    for k in range(1, WORDS):
        acc += h[k:k + n] * _ODD[k]
    return np.unique(mixed(acc))
