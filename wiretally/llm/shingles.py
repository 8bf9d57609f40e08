"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from wiretally.llm.anchors import mix

WORD = re.compile(r"\w+")
PRIME = np.uint64(0x100000001B3)
CACHED = 400_000


class Shingler:
    """Hashes of all runs of ``size`` words in lower case; a shorter text is one shingle, a text without words has none."""

    def __init__(self, size: int = 5):
        self.size = size
        self.known: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        found = WORD.findall((text or "").lower())
        if len(self.known) > CACHED:
            self.known = {}
        numbers = list(map(self.known.get, found))
        if None in numbers:
            for i, number in enumerate(numbers):
                if number is None:
                    numbers[i] = self.known[found[i]] = xxhash.xxh64_intdigest(found[i])
        return np.array(numbers, np.uint64)

    def in_order(self, text: str | None) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        size = min(self.size, len(words))
        n = len(words) - size + 1
        joined = words[:n].copy()
        for step in range(1, size):
            joined = joined * PRIME + words[step : step + n]
        return mix(joined + np.uint64(size))

    def set_of(self, text: str | None) -> np.ndarray:
        return np.unique(self.in_order(text))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)
