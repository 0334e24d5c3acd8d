"""Word shingles hashed with numpy, a batch of texts at a time."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_MUL_A = np.uint64(0xFF51AFD7ED558CCD)
_MUL_B = np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise."""
    x = (x ^ (x >> _SHIFT)) * _MUL_A
    x = (x ^ (x >> _SHIFT)) * _MUL_B
    return x ^ (x >> _SHIFT)


class WordHasher:
    """Word to 64-bit hash with a bounded cache; the hash never depends on the cache."""

    def __init__(self, capacity: int = 500_000):
        self.cache: dict[str, int] = {}
        self.capacity = capacity

    def __call__(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > self.capacity:
            cache.clear()
        out = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = cache.get(w)
            if h is None:
                h = cache[w] = xxhash.xxh64_intdigest(w)
            out[i] = h
        return out


def words_of(text: str) -> list[str]:
    """Runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def shingle_sets(texts: list[str | None], size: int, hasher: WordHasher) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; empty if it has too few words."""
    words: list[str] = []
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            words += words_of(t)
        ends[i + 1] = len(words)
    none = np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return [none] * len(texts)
    h = hasher(words)
    n = len(h) - size + 1
    g = h[:n].copy()
    for k in range(1, size):
        g = mix(g * np.uint64(31) + h[k : k + n])
    return [np.unique(g[a : max(a, b - size + 1)]) if b - a >= size else none for a, b in zip(ends[:-1], ends[1:], strict=True)]
