"""The binary Golay code of length 23: every word lies within 3 errors of exactly one of 4096 codewords."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
#: Codewords within four errors of a word: one, or six where the nearest has three errors.
MOST = 6


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << bit - CHECK
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of all words, by bytes; and for each remainder the error patterns of up to 4 bits that have it (-1: no more)."""
    bytes_ = np.array([[_remainder(b << 8 * k) if b << 8 * k < 1 << LENGTH else 0 for b in range(256)] for k in range(3)], np.uint16)
    errors: list[list[int]] = [[] for _ in range(1 << CHECK)]
    single = [_remainder(1 << b) for b in range(LENGTH)]
    for size in range(5):
        for bits in combinations(range(LENGTH), size):
            left = 0
            for b in bits:
                left ^= single[b]
            errors[left].append(sum(1 << b for b in bits))
    out = np.full((1 << CHECK, MOST), -1, np.int64)
    for i, found in enumerate(errors):
        out[i, :len(found)] = found
    return bytes_, out


def near(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of all codewords within four errors, nearest first; -1 where there are no more.

    Words that differ in one bit share an index: the codeword nearest to the one, at most three
    errors away, is at most four from the other.
    """
    parts, errors = _tables()
    words = words.astype(np.int64)
    left = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16]
    found = errors[left]
    return np.where(found >= 0, (words[:, None] ^ found) >> CHECK, -1)
