"""Arrow batches of texts as numpy arrays: words, their hashes, and sliding windows over them.

Texts stay UTF-8 bytes in one buffer; a batch is cut into slices of a MB, so the memory of a
task depends on the slice size and on the longest single text, not on the number of rows.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm.shipping import ship

SLICE_BYTES = 1 << 20
#: Bytes that `[\x20\x09-\x0D]` matches.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_RNG = np.random.default_rng(20240607)
_BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict] | None], schema: str
) -> DataFrame:
    """``mapInArrow`` for a function that turns a batch into dicts of columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(
                    [_as_array(columns[field.name], field.type) for field in arrow], schema=arrow
                )

    return map_partitions(df, run, schema)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows, for jobs run inside whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def map_partitions(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow``, with this package's code on the executors."""
    ship(df.sparkSession)
    stage = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(stage)
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


#: Called when a Python worker goes on to another stage: they drop what only the stage before needed.
CACHES: list[Callable[[], None]] = []
_stage: list[str] = []


def enter(stage: str) -> None:
    """Tell the process which stage it works for; what it has kept for another one goes."""
    if _stage != [stage]:
        for clear in CACHES:
            clear()
        _stage[:] = [stage]


def give_back() -> None:
    """Return free memory to the system: workers outlive their tasks, and allocators keep what was freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of ``column``; a longer text is a piece of its own."""
    _, offsets = utf8(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACES
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of all words, and the first word of each row (one more at the end).

    ``space`` marks the byte values that separate words; a row's end separates them too.
    """
    inside = ~space[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    if len(before):
        before[0] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    if len(after):
        after[-1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), _POWER)
    powers[0] = 1
    powers = np.cumprod(powers)
    values = _BYTE_KEYS[data[at + np.repeat(starts, lengths)]] * powers[at]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive entries; runs over row ends are the caller's."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total *= _POWER
        total += words[i : i + n]
    return mix(total + np.uint64(size))


def window_starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a run of ``size`` words lies within one row."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    return np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any of the intervals [start, end)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def rows_of(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The row each position belongs to."""
    return np.searchsorted(bounds, positions, side="right") - 1


def fresh_name(name: str, taken: set[str]) -> str:
    """``name``, with underscores in front until no column in ``taken`` has it; the result is added to ``taken``."""
    while name in taken:
        name = "_" + name
    taken.add(name)
    return name
