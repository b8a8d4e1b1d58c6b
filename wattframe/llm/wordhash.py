"""64-bit hashes of words and of runs of words, for whole documents at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a worker remembers before it starts anew.
REMEMBERED = 300_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SHIFT = np.uint64(29)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _SHIFT)) * _MIX
    return h ^ (h >> _SHIFT)


def factors(n: int) -> np.ndarray:
    """Odd multipliers, one for each place in a run."""
    return np.array([xxhash.xxh3_64_intdigest(str(k).encode(), seed=n) | 1 for k in range(n)], np.uint64)


def runs(w: np.ndarray, n: int, by: np.ndarray) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h += w[k : len(w) - n + 1 + k] * by[k]
    return mix(h)
