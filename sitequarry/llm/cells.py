"""Long arrays of counts, summed over all tasks: shipped in blocks, so that each block is added up on its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitequarry.llm.batches import map_partitions
from sitequarry.operators.lineage import Workspace

BLOCK = 4096
_KINDS = "name string, block int, counts binary"
_NAMES = ["name", "block", "counts"]


def sum_cells(
    rows: DataFrame,
    count: Callable[[pa.RecordBatch], Iterable[tuple[str, np.ndarray]]],
    n_cells: int,
    workspace: Workspace,
) -> dict[str, np.ndarray]:
    """The sum of the arrays of ``n_cells`` (a multiple of BLOCK) that ``count`` yields for each name.

    The result is held on the driver: its size is the number of names times ``n_cells``.
    """

    def fill(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, counts in count(batch):
                totals[name] = totals[name] + counts if name in totals else counts.astype(np.int64)
        for name, counts in totals.items():
            blocks = counts.reshape(-1, BLOCK)
            some = np.flatnonzero(blocks.any(axis=1))
            yield _batch([name] * len(some), some, [blocks[i].tobytes() for i in some])

    def add(batches):
        totals: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, block, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(counts, np.int64)
                key = (name, block)
                totals[key] = totals[key] + counts if key in totals else counts
        yield _batch([n for n, _ in totals], [b for _, b in totals], [t.tobytes() for t in totals.values()])

    parts = map_partitions(rows, fill, _KINDS).repartition("name", "block")
    summed = workspace.table(map_partitions(parts, add, _KINDS), "cells")
    found: dict[str, np.ndarray] = {}
    for name, block, counts in summed.toLocalIterator():
        cells = found.setdefault(name, np.zeros(n_cells, np.int64))
        cells[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(counts, np.int64)
    return found


def _batch(names, blocks, counts) -> pa.RecordBatch:
    arrays = [pa.array(names, pa.string()), pa.array(blocks, pa.int32()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)
