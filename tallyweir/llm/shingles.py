"""64-bit hashes of words and of runs of words, shared by the operators on shingles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
KEPT_WORDS = 300_000


class WordHashes(dict):
    """Word (bytes) to hash; forgets all when full, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n neighbours, in order; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * _FACTOR + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out + np.uint64(n))


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct runs; of fewer than n words the whole sequence is the one shingle."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes, min(n, len(hashes))))
