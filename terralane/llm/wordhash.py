"""Hashes of the words of many texts at once, by prefix sums over their bytes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20_240_607).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (two rounds of multiply and shift)."""
    x = x + np.uint64(seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            all_ = np.full(n + n // 2, base, np.uint64)
            all_[0] = 1
            _powers[k] = np.cumprod(all_)
    return _powers[0], _powers[1]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes wherever they stand."""
    up, down = _grown(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word (A-Z in lower case, parted by ASCII white space), and each text's first word (with the count appended)."""
    parts = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    docs = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return range_hashes(data, starts, ends), np.searchsorted(starts, docs)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words; none when there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n]
    return mix(out)
