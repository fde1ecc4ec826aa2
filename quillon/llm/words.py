"""Words, their hashes and shingles, as numpy arrays inside Python workers."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is an unbroken run of letters or digits.
WORD = re.compile(r"[^\W_]+")

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Hashes(dict):
    """Word -> 64-bit hash; emptied once it holds a million words, so that its memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M2
    x = x ^ (x >> np.uint64(27))
    x = x * _M3
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def hashed(tokens: list[str], cache: Hashes) -> np.ndarray:
    return np.fromiter((cache[w] for w in tokens), np.uint64, len(tokens))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words, in order; empty where there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + h[k : k + n]) * _M1
        out ^= out >> np.uint64(29)
    return mix(out)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets given as sorted arrays without repeats; 0 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 0.0
