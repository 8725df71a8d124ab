"""Words, word hashes and shingles shared by the text operators.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  ``bytes.split()`` splits on
exactly those six ASCII characters and ``bytes.lower()`` touches A-Z alone, so
texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

MULT = np.uint64(0x9E3779B97F4A7C15)
_WORD_CACHE = 300_000


class WordHashes(dict):
    """64-bit hash of each word, cached; the cache is emptied when it is full."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, seed=self.seed)
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` consecutive word hashes (empty if there is none)."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= MULT
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def shingle_set(text: str | None, hashes: WordHashes, n: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of the lower-cased text; a text of fewer
    than ``n`` words is one shingle, a text without words has none."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if len(h) < n:
        return window_hashes(h, len(h)) ^ np.uint64(len(h))
    return distinct(window_hashes(h, n))


def distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


#: Of this Python worker; it is used again for later groups and tasks.
WORD_HASHES = WordHashes()


def fingerprint(values: np.ndarray) -> bytes:
    """128-bit digest of a sorted hash set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
