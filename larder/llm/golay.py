"""Fuzzy hashing with the perfect binary Golay code of length 23.

Every 23-bit word lies within 3 bits of exactly one codeword.  Its indices are all
codewords within 4 bits: one where the nearest is at most 2 bits away, else six.  Two
words that differ in at most 2 bits have a word between them that is within 1 bit of
both and within 3 of some codeword, so they share an index.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
MOST_INDICES = 6


def _syndrome(word: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by byte, and for each syndrome the error patterns of its indices and their number."""
    by_byte = np.array([[_syndrome(b << 8 * k & (1 << BITS) - 1) for b in range(256)] for k in range(3)], dtype=np.int64)
    near: list[list[int]] = [[] for _ in range(2048)]
    least = [5] * 2048
    single = [_syndrome(1 << i) for i in range(BITS)]
    for weight in range(5):
        for places in combinations(range(BITS), weight):
            s = pattern = 0
            for p in places:
                s ^= single[p]
                pattern |= 1 << p
            least[s] = min(least[s], weight)
            near[s].append(pattern)
    patterns = np.zeros((2048, MOST_INDICES), dtype=np.int64)
    count = np.zeros(2048, dtype=np.int64)
    for s, found in enumerate(near):
        count[s] = len(found)
        patterns[s, : len(found)] = found
    return by_byte, patterns, count


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its 1 or 6 codeword indices (12 bits, unused places repeat none) and how many."""
    by_byte, patterns, count = _tables()
    words = words.astype(np.int64)
    s = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16 & 255]
    return (words[:, None] ^ patterns[s]) >> 11, count[s]


#: The three segments of a 64-bit fingerprint: lowest bit and width.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 64-bit fingerprints and the row that each belongs to.

    Of two differing bits at most, one segment of three has none; the next segment
    then has at most two, so the pair shares one of its indices.  A key is the number
    of the exact segment, its bits, and an index of the next one.
    """
    rows, out = [], []
    for k, (at, width) in enumerate(SEGMENTS):
        exact = (prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        to, wide = SEGMENTS[(k + 1) % 3]
        index, n = indices(prints >> np.uint64(to) & np.uint64((1 << wide) - 1))
        for j in range(MOST_INDICES):
            use = np.flatnonzero(n > j)
            rows.append(use)
            out.append((exact[use] << 14) | (index[use, j] << 2) | k)
    return np.concatenate(out), np.concatenate(rows)
