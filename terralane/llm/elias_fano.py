"""Elias-Fano coding of non-decreasing integers, with select samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: A sample of every so many set bits; a lookup reads on from the sample before it.
SAMPLE = 64


@dataclass(frozen=True)
class EliasFano:
    """``count`` values in about 2 + log2(largest / count) bits each.

    The low ``width`` bits of all values stand packed one after the other; the rest is a bit string in
    which value i sets bit (value >> width) + i. ``samples`` are the places of every 64th set bit.
    """
    count: int
    width: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        if values[0] < 0 or (np.diff(values) < 0).any():
            raise ValueError("values must be non-negative and in ascending order")
        width = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width)) & 1
        places = (values >> width) + np.arange(n)
        high = np.zeros(int(places[-1]) + 1, np.uint8)
        high[places] = 1
        return cls(n, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
                   np.packbits(high, bitorder="little").tobytes(), places[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The place of set bit ``i``, from the sample before it."""
        place, left = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE]), i % SAMPLE
        if not left:
            return place
        at, skip = divmod(place + 1, 8)
        while True:
            bits = np.unpackbits(np.frombuffer(self.high[at:at + 64], np.uint8), bitorder="little")[skip:]
            ones = np.flatnonzero(bits)
            if len(ones) >= left:
                return at * 8 + skip + int(ones[left - 1])
            left -= len(ones)
            at, skip = at + 64, 0

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.count:
            raise IndexError(i)
        low, start = 0, i * self.width
        if self.width:
            piece = int.from_bytes(self.low[start // 8:(start + self.width + 7) // 8], "little")
            low = piece >> start % 8 & (1 << self.width) - 1
        return (self.select(i) - i) << self.width | low

    def part(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` (a multiple of SAMPLE) to ``stop``, read from the sample of the first to that of the next after the last."""
        if start % SAMPLE:
            raise ValueError(f"parts start at multiples of {SAMPLE}")
        stop = min(stop, self.count)
        if start >= stop:
            return np.zeros(0, np.int64)
        samples = np.frombuffer(self.samples, "<u4")
        begin, after = int(samples[start // SAMPLE]), -(-stop // SAMPLE)
        end = int(samples[after]) if after < len(samples) else 8 * len(self.high)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, -(-end // 8) - begin // 8, begin // 8), bitorder="little")
        places = (np.flatnonzero(bits) + begin // 8 * 8)
        places = places[np.searchsorted(places, begin):][:stop - start]
        return (places - np.arange(start, stop) << self.width) + self._low(start, stop)

    def _low(self, start: int, stop: int) -> np.ndarray:
        if not self.width:
            return np.zeros(stop - start, np.int64)
        at, end = start * self.width, stop * self.width
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8, -(-end // 8) - at // 8, at // 8), bitorder="little")[at % 8:at % 8 + end - at]
        return (bits.reshape(stop - start, self.width).astype(np.int64) << np.arange(self.width)).sum(axis=1)

    def all(self) -> np.ndarray:
        return self.part(0, self.count)
