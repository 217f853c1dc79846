"""Two Bloom filters, for keys seen once and keys seen twice, built in a distributed way.

Every task fills a pair of filters from its own keys; pairs merge by
``twice = twice | twice' | (once & once')`` and ``once = once | once'``, in any order.  The filters
are cut into segments by the top bits of a key's hash, so a task ships only the bits it set and each
segment is merged on its own.  A key that was added twice is always in the second filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitequarry.llm.batches import map_partitions, mix

SEGMENT_BITS = 19
BITS_PER_KEY = 16
#: The filter that is broadcast has at most 2**30 bits (128 MB).  With more keys than that allows,
#: more of them are suspected and confirmed; none is lost.
MAX_LOG_BITS = 30
N_HASHES = 4
_FLUSH = 2_000_000


def log_bits(n_keys: int) -> int:
    """Size of a filter for so many keys, as a power of two, between one segment and the bound."""
    return min(max(int(n_keys * BITS_PER_KEY).bit_length(), SEGMENT_BITS), MAX_LOG_BITS)


def _places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each key, and its N_HASHES bits there."""
    shift = np.uint64(size - SEGMENT_BITS)
    segments = (hashes >> np.uint64(32)) & ((np.uint64(1) << shift) - np.uint64(1))
    bits, h = [], hashes
    for _ in range(N_HASHES):
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
        bits.append(h & np.uint64((1 << SEGMENT_BITS) - 1))
    return segments.astype(np.int64), np.stack(bits, axis=1).astype(np.uint32)


def _pack(bits: np.ndarray) -> bytes:
    """Bit numbers as numbers, or as a bitmap where that is shorter; the first byte says which."""
    bits = np.unique(bits)
    if len(bits) * 32 < 1 << SEGMENT_BITS:
        return b"n" + bits.astype("<u4").tobytes()
    return b"b" + np.packbits(_mask(bits)).tobytes()


def _mask(bits: np.ndarray) -> np.ndarray:
    mask = np.zeros(1 << SEGMENT_BITS, bool)
    mask[bits] = True
    return mask


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"n":
        return _mask(np.frombuffer(data, "<u4", offset=1))
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=1)).view(bool)


def seen_twice(
    rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: int
) -> DataFrame:
    """(segment, bits) of the second filter over the hashes that ``hashes_of`` finds in ``rows``."""
    part = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for hashes in hashes_of(batch):
                held.append(hashes)
                n += len(hashes)
                if n >= _FLUSH:
                    yield from pairs(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from pairs(np.concatenate(held))

    def pairs(hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        hashes, counts = np.unique(hashes, return_counts=True)
        segments, bits = _places(hashes, size)
        order = np.argsort(segments, kind="stable")
        segments, bits, again = segments[order], bits[order], counts[order] > 1
        names, first = np.unique(segments, return_index=True)
        cuts = [*first.tolist(), len(segments)]
        for at in range(0, len(names), 64):
            rows = range(at, min(at + 64, len(names)))
            once = [_pack(bits[cuts[i] : cuts[i + 1]].ravel()) for i in rows]
            twice = [
                _pack(bits[cuts[i] : cuts[i + 1]][again[cuts[i] : cuts[i + 1]]].ravel())
                for i in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[list(rows)], pa.int32()), pa.array(once), pa.array(twice)],
                schema=part,
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, None, None
        out = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])

        def done():
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()])], schema=out
            )

        for batch in batches:
            for segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if segment != at:
                    if at is not None:
                        yield done()
                    at = segment
                    once, twice = np.zeros((2, 1 << SEGMENT_BITS), bool)
                more = _unpack(a)
                twice |= _unpack(b) | (once & more)
                once |= more
        if at is not None:
            yield done()

    filled = map_partitions(rows, fill, "segment int, once binary, twice binary")
    dealt = filled.repartition("segment").sortWithinPartitions("segment")
    return map_partitions(dealt, merge, "segment int, bits binary")


class SeenTwice:
    """The second filter as one bitmap; pickled into a broadcast of at most 2**MAX_LOG_BITS bits."""

    def __init__(self, segments: DataFrame, size: int):
        self.size = size
        self.bits = np.zeros((1 << (size - SEGMENT_BITS), 1 << (SEGMENT_BITS - 3)), np.uint8)
        for segment, bits in segments.toLocalIterator():
            self.bits[segment] = np.frombuffer(bits, np.uint8)

    def __contains__(self, hash_: int) -> bool:
        return bool(self.suspects(np.array([hash_], np.uint64))[0])

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes may have been added more than once."""
        segments, bits = _places(hashes, self.size)
        found = np.ones(len(hashes), bool)
        for column in bits.T:
            byte = self.bits[segments, column >> 3]
            found &= (byte >> (7 - (column & 7)).astype(np.uint8)) & 1 > 0
        return found
