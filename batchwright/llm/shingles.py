"""Hashes of words and of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, held for the words seen lately."""

    def __init__(self, cap: int = 100_000):
        super().__init__()
        self.cap = cap

    def __missing__(self, word: str) -> int:
        if len(self) >= self.cap:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash for each run of ``size`` words, repeats included; a shorter text that isn't empty is one run."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * MIX + words[i : n - k + 1 + i]
    return mix(h)


def runs_repeated(words: np.ndarray, size: int = 8) -> int:
    """Words that lie in a run of ``size`` (a power of two) words found twice or more. Exact: equal runs are found
    by numbering the distinct runs of 1, 2, 4, ... words."""
    n = len(words)
    if n <= size:
        return 0
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    k = 1
    while k < size:
        rank = rank[: n - 2 * k + 1] * n + rank[k : n - k + 1]
        k *= 2
        values, rank, counts = np.unique(rank, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[rank] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + size, -1)
    return int((np.cumsum(cover[:n]) > 0).sum())
