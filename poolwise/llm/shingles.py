"""Word shingles as 64-bit hashes, for whole slices of documents at once."""

from __future__ import annotations

import numpy as np

WORDS_CACHED = 400_000
SIZE = 5
GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORDS_CACHED:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_WORDS = WordHashes()


def shingle_sets(bodies: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each body, sorted, in one array, and the bounds of each body's part.

    Words are runs without ASCII white space, A-Z in lower case. A body of fewer words than ``size``
    has its whole sequence as its one shingle; without words it has none.
    """
    split = [b.lower().split() for b in bodies]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = np.fromiter((h for ws in split for h in map(_WORDS.__getitem__, ws)), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    first = ends - counts
    n_shingles = np.where(counts >= size, counts - size + 1, 0)
    rolled = np.zeros(0, np.uint64)
    if len(words) >= size:
        rolled = np.full(len(words) - size + 1, np.uint64(size), np.uint64)
        for k in range(size):
            rolled = mix(rolled * GOLD + words[k : k + len(rolled)])
    parts, bounds = [], np.zeros(len(bodies) + 1, np.int64)
    for i, (at, n, c) in enumerate(zip(first.tolist(), n_shingles.tolist(), counts.tolist(), strict=True)):
        if n:
            found = np.unique(rolled[at : at + n])
        elif c:
            total = np.full(1, np.uint64(c), np.uint64)
            for word in words[at : at + c]:
                total = mix(total * GOLD + word)
            found = total
        else:
            found = rolled[:0]
        parts.append(found)
        bounds[i + 1] = bounds[i] + len(found)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds
