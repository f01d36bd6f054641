"""Word shingles of a text as 64-bit hashes. Words are `[^\\x20\\x09-\\x0D]+`."""

from __future__ import annotations

import numpy as np
import xxhash

SIZE = 5


class WordHashes(dict):
    """bytes -> 64-bit hash; forgets all when it holds `limit` words."""

    def __init__(self, limit: int = 200_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, cache: WordHashes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer than `size` words is one shingle, one without words has none."""
    words = text.encode("utf-8", "replace").split()  # of bytes: exactly the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = mix(out ^ h[j : j + len(out)]) + np.uint64(j + 1)
    return np.unique(out)
