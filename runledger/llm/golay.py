"""Golay-code fuzzy hashing: words of up to 23 bits to the indices of nearby codewords.

The binary Golay code (23, 12) is perfect: each word is within 3 bits of one codeword. A word 3 bits
away from it has 5 more codewords at 4 bits. With these 6 (or the 1) as keys, two words that differ
in at most 2 bits share a key, and the nearest codeword of one of two words that differ in at most 1
bit is among the keys of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
BITS, CHECK = 23, 11


def _remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    single = [_remainder(1 << b) for b in range(BITS)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for b in range(12):
        low[np.arange(1 << 12) >> b & 1 == 1] ^= single[b]
    for b in range(11):
        high[np.arange(1 << 11) >> b & 1 == 1] ^= single[12 + b]
    patterns: list[list[int]] = [[] for _ in range(1 << CHECK)]
    for weight in range(5):
        for bits in combinations(range(BITS), weight):
            s = 0
            for b in bits:
                s ^= single[b]
            # A coset of a lighter leader than 3 bits has no pattern of 4 bits.
            patterns[s].append(sum(1 << b for b in bits))
    out = np.full((1 << CHECK, 6), -1, np.int64)
    for s, found in enumerate(patterns):
        out[s, : len(found)] = found
    return low, high, out


_LOW, _HIGH, _PATTERNS = _tables()


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices, the nearest codeword first; -1 where there is none."""
    words = words.astype(np.int64)
    errors = _PATTERNS[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK)
