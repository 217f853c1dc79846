"""Wavelet matrix: a sequence of numbers as bit-planes with rank and select.

Plane by plane from the highest bit, numbers with bit 0 are moved before those with bit 1, in order.  A
position is followed through the planes by rank, an occurrence back up by select.
"""

from __future__ import annotations

import numpy as np


class BitPlane:
    """Bits with constant-time rank: 64-bit words and the number of ones before each."""

    def __init__(self, packed: np.ndarray, n: int):
        """``packed``: bytes of ``n`` bits, first bit lowest."""
        words = np.zeros(n // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.n, self.words = n, words
        before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=before[1:])
        self.before = before.astype(np.int32 if n < 2**31 else np.int64)
        self.ones = int(before[-1])
        self.zeros = n - self.ones

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)

    def select(self, which: np.ndarray, bit: int) -> np.ndarray:
        """Position of the given (0-based) ones or zeros."""
        before = self.before[:-1] if bit else 64 * np.arange(len(self.words)) - self.before[:-1]
        block = np.searchsorted(before, which, side="right") - 1
        words = self.words[block] if bit else ~self.words[block]
        bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen = np.cumsum(bits, axis=1)
        return block * 64 + np.argmax(seen > (which - before[block])[:, None], axis=1)


class WaveletMatrix:
    def __init__(self, planes: list[BitPlane], n: int):
        self.planes, self.n = planes, n

    @classmethod
    def of(cls, values: np.ndarray, n_planes: int) -> WaveletMatrix:
        planes = []
        for shift in range(n_planes - 1, -1, -1):
            bits = (values & values.dtype.type(1 << shift)) != 0
            plane = BitPlane(np.packbits(bits, bitorder="little"), len(values))
            planes.append(plane)
            below = np.empty_like(values)
            values.take(np.flatnonzero(~bits), out=below[: plane.zeros], mode="clip")
            values.take(np.flatnonzero(bits), out=below[plane.zeros :], mode="clip")
            values = below
        return cls(planes, len(values))

    def values(self, dtype=np.uint32) -> np.ndarray:
        """All numbers, in order: the planes undone from the lowest."""
        values = np.zeros(self.n, dtype)
        for shift, plane in enumerate(reversed(self.planes)):
            bits = plane.bits()
            ones = np.flatnonzero(bits)
            above = np.empty_like(values)
            above[np.flatnonzero(~bits)] = values[: plane.zeros]
            above[ones] = values[plane.zeros :] | dtype(1 << shift)
            values = above
        return values

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at some positions."""
        at = np.asarray(at, np.int64)
        found = np.zeros(len(at), np.int64)
        for plane in self.planes:
            bit, ones = plane.get(at), plane.rank(at)
            found = found * 2 + bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return found

    def follow(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the planes lead each number's share of the positions before ``at``: its rank there,
        plus a place that depends on the number alone."""
        for plane, shift in zip(self.planes, range(len(self.planes) - 1, -1, -1), strict=True):
            ones = plane.rank(at)
            at = np.where((values >> shift) & 1 > 0, plane.zeros + ones, at - ones)
        return at

    def rank(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number occurs before its position."""
        values, at = np.asarray(values, np.int64), np.asarray(at, np.int64)
        return self.follow(values, at) - self.follow(values, np.zeros_like(at))

    def locate(self, value: int) -> np.ndarray:
        """All positions of a number, in order."""
        low, high = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        bits = [(value >> s) & 1 for s in range(len(self.planes) - 1, -1, -1)]
        for plane, bit in zip(self.planes, bits, strict=True):
            a, b = plane.rank(low), plane.rank(high)
            low, high = (plane.zeros + a, plane.zeros + b) if bit else (low - a, high - b)
        at = np.arange(int(low[0]), int(high[0]))
        for plane, bit in zip(reversed(self.planes), reversed(bits), strict=True):
            at = plane.select(at - plane.zeros if bit else at, bit)
        return at
