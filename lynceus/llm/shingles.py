"""Hashes of words and of five-word shingles, for the operators that run on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Distinct words that a task remembers.
KEPT_WORDS = 150_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of a text's words: runs without ASCII white space, A-Z lower-cased."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        words = (text or "").encode("utf-8", "replace").lower().split()
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of each run of five words in order; of fewer words, one hash of all; of none, nothing."""
    n = len(words)
    if n == 0:
        return words
    if n < WORDS:
        h = np.uint64(n)
        for w in words:
            h = mix((np.array([w], np.uint64) + h) * _ODD[0])[0]
        return np.array([h], np.uint64)
    h = np.zeros(n - WORDS + 1, np.uint64)
    for i in range(WORDS):
        h += words[i : n - WORDS + 1 + i] * _ODD[i]
    return mix(h)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(words))
