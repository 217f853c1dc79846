"""FM-index: a shard's text as the wavelet matrix of its Burrows-Wheeler transform, searched backwards."""

from __future__ import annotations

import numpy as np

from sitequarry.llm.wavelet import WaveletMatrix


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` or more numbers that start there."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth:
        following = np.zeros(len(ids), np.int64)
        following[: len(ids) - reach] = rank[reach:] + 1
        keys, rank = np.unique(rank * (len(ids) + 1) + following, return_inverse=True)
        reach *= 2
        if len(keys) == len(ids):
            break
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Counts and matching statistics of patterns of at most ``depth`` numbers."""

    def __init__(self, ids: np.ndarray, depth: int):
        """``ids``: small non-negative numbers; 0 separates texts and is not searched for."""
        order = suffix_order(ids, depth)
        n_symbols = int(ids.max()) + 1 if len(ids) else 1
        self.n = len(ids)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n_symbols))])
        self.matrix = WaveletMatrix.of(ids[order - 1].astype(np.uint32), (n_symbols - 1).bit_length())
        symbols = np.arange(n_symbols)
        self.shift = self.below[:-1] - self.matrix.follow(symbols, np.zeros(n_symbols, np.int64))

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The rows of each pattern with one more symbol in front."""
        both = self.matrix.follow(np.tile(symbols, 2), np.concatenate([low, high]))
        shift = self.shift[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def count(self, pattern: np.ndarray) -> int:
        low, high = np.zeros(1, np.int64), np.full(1, self.n, np.int64)
        for symbol in pattern[::-1]:
            if symbol >= len(self.shift):
                return 0
            low, high = self.extend(np.full(1, symbol), low, high)
        return int(high[0] - low[0])

    def matching_statistics(self, ids: np.ndarray, ends: np.ndarray, limits: np.ndarray, times: int = 2):
        """For each end: how many numbers up to there (at most its limit) occur ``times`` or more
        in the index.  All ends are searched at once, one step back at a time."""
        found = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        symbols = ids[ends]
        low, high = self.below[symbols], self.below[symbols + 1]
        for step in range(1, int(limits.max(initial=0)) + 1):
            stays = (high - low >= times) & (limits[live] >= step)
            live, low, high = live[stays], low[stays], high[stays]
            found[live] = step
            going = limits[live] > step
            live, low, high = live[going], low[going], high[going]
            if not len(live):
                break
            low, high = self.extend(ids[ends[live] - step], low, high)
        return found
