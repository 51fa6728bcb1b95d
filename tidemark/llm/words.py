"""64-bit hashes of words and word shingles, a document at a time."""

from __future__ import annotations

import hashlib

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """8 bytes for each word, kept for the words seen of late."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = hashlib.blake2b(word, digest_size=8).digest()
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hash of each word."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread each value over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _B
    return h ^ (h >> np.uint64(29))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; of the whole sequence if it is shorter, none if it is empty."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = hashes[: n - k + 1].copy()
    for i in range(1, k):
        out = mix64(out * _A + hashes[i : n - k + 1 + i])
    return np.unique(mix64(out + np.uint64(k)))
