"""Words, word hashes and hash arithmetic on uint64 arrays.

A word is ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` cuts at exactly these six
bytes, and ``bytes.lower()`` changes exactly A-Z.
"""

from __future__ import annotations

import numpy as np
import xxhash

from gridloom.llm.frames import memory

#: Odd multipliers (the golden-ratio constant of splitmix64 and two of its mixers).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
#: Entries of a worker's word cache before it starts anew; about 150 bytes each.
CACHE_ENTRIES = 200_000


class WordHashes(dict):
    """bytes -> 64-bit hash; remembers what it has hashed."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_cache = WordHashes()


def split(text: str | None, lower: bool = False) -> list[bytes]:
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hashed(words: list[bytes]) -> np.ndarray:
    """uint64 hash of each word."""
    with memory("words", _cache.clear):
        if len(_cache) > CACHE_ENTRIES:
            _cache.clear()
        return np.fromiter(map(_cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a document's n-word shingles.

    With fewer than n words the whole sequence counts as one shingle; without
    words there is none.
    """
    if len(h) == 0:
        return np.empty(0, np.uint64)
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, (size * int(GOLDEN)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(size):
        out = mix(out + h[i : len(h) - size + 1 + i])
    return np.unique(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
