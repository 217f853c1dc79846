"""Benchmark decontamination: a broadcast hash set of test n-grams, against which training texts are scanned.

Both sides are normalised alike: A-Z become lower case, words are runs of letters, digits and
non-ASCII characters.  A window is ``n`` consecutive words of an item; a shorter item is one window.
Each task slides over its texts, looks every window's hash up in the set, and compares the words of
each hit, so a hash collision is never reported.

Defined cases: a null or empty text has no words and is not contaminated; an item without words has
no window; a null item_id is ignored in the list of items but its windows count; repeated items and
rows count once per row of ``docs``; a column of ``docs`` with the name of a result is replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.batches import (
    covered,
    map_batches,
    rows_of,
    slices,
    utf8,
    window_hashes,
    window_starts,
    word_hashes,
    word_spans,
)
from sitequarry.operators.lineage import Workspace

#: Bytes of benchmark text that one broadcast set is made of; a larger benchmark takes several passes.
BLOCK_BYTES = 16 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_MARKS = 20


class NgramSet:
    """The windows of some items: hashes to look up, words to verify, and whose they are."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.owners: dict[bytes, set] = {}
        for item_id, text in items:
            words = _words((text or "").encode())
            size = min(n, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                self.owners.setdefault(b" ".join(words[i : i + size]), set()).add(item_id)
        windows: dict[int, list[bytes]] = {}
        for window in self.owners:
            windows.setdefault(window.count(b" ") + 1, []).append(window)
        self.hashes, self.marks = {}, {}
        for size, texts in windows.items():
            data, offsets = utf8(pa.array([t.decode("utf-8", "surrogatepass") for t in texts]))
            starts, ends, _ = word_spans(data, offsets, _BREAKS)
            found = window_hashes(word_hashes(data, starts, ends), size)[::size]
            self.hashes[size] = np.unique(found)
            self.marks[size] = np.zeros(1 << _MARKS, bool)
            self.marks[size][found >> np.uint64(64 - _MARKS)] = True

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        """Hits in normalised texts: bounds of words by row, hit words, and (row, item) pairs."""
        starts, ends, bounds = word_spans(data, offsets, _BREAKS)
        hashes = word_hashes(data, starts, ends)
        begins, stops, owners = [], [], []
        for size in self.hashes:
            grams = window_hashes(hashes, size)
            at = window_starts(bounds, size)
            at = at[self.marks[size][grams[at] >> np.uint64(64 - _MARKS)]]
            known = self.hashes[size]
            place = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
            at = at[known[place] == grams[at]]
            for first, row in zip(at.tolist(), rows_of(at, bounds).tolist(), strict=True):
                text = data[starts[first] : ends[first + size - 1]].tobytes()
                items = self.owners.get(b" ".join(_words(text)))
                if items:
                    begins.append(first)
                    stops.append(first + size)
                    owners += [(row, item) for item in items if item is not None]
        hit = covered(np.array(begins, np.int64), np.array(stops, np.int64), len(starts))
        return starts, ends, bounds, hit, set(owners)


_TABLE = bytes(32 if _BREAKS[_FOLD[b]] else int(_FOLD[b]) for b in range(256))


def _words(text: bytes) -> list[bytes]:
    return [word for word in text.translate(_TABLE).split(b" ") if word]


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    workspace: Workspace,
    n: int = 10,
    remove: str = "none",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids of items that occur) and contaminated.

    ``remove="spans"`` also cuts the hit words, with what separates them, out of ``text``;
    ``remove="documents"`` leaves contaminated rows out.  The set is broadcast in blocks of
    at most about ``block_bytes`` of benchmark text, one pass over the documents for each.
    """
    if remove not in ("none", "spans", "documents"):
        raise ValueError(f"remove: {remove}")
    results = {"n_words": "long", "n_hit": "long", "items": "array<string>", "_spans": "array<bigint>"}
    added = {name: F.lit(None).cast(kind) for name, kind in results.items()}
    found = docs.drop("contaminated").withColumns(added)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    items = benchmark.select("item_id", "text")
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        known = workspace.spark.sparkContext.broadcast(
            NgramSet([tuple(row) for row in part.toLocalIterator()], n)
        )
        found = _scan(found, known)
        if block + 1 < blocks:
            found = workspace.table(found, "scanned")
    found = found.withColumn("contaminated", F.col("n_hit") > 0)
    if remove == "documents":
        found = found.filter(~F.col("contaminated"))
    if remove == "spans":
        found = _cut(found)
    return found.drop("_spans")


def _scan(docs: DataFrame, known) -> DataFrame:
    names = docs.columns

    def scan(batch: pa.RecordBatch):
        for part in slices(batch):
            data, offsets = utf8(part.column("text"))
            starts, ends, bounds, hit, owners = known.value.scan(_FOLD[data], offsets)
            items = [set(x or ()) for x in part.column("items").to_pylist()]
            for row, item in owners:
                items[row].add(str(item))
            spans = []
            for row, old in enumerate(part.column("_spans").to_pylist()):
                mine = hit[bounds[row] : bounds[row + 1]]
                for start, end in zip(old[::2], old[1::2], strict=True) if old else ():
                    mine[start:end] = True
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]])))
                spans.append(edges.tolist())
            columns = {name: part.column(name) for name in names}
            yield columns | {
                "n_words": np.diff(bounds),
                "n_hit": [sum(s[1::2]) - sum(s[::2]) for s in spans],
                "items": [sorted(x) for x in items],
                "_spans": spans,
            }

    return map_batches(docs, scan, _schema(docs))


def _cut(docs: DataFrame) -> DataFrame:
    names = docs.columns

    def cut(batch: pa.RecordBatch):
        for part in slices(batch):
            data, offsets = utf8(part.column("text"))
            starts, ends, bounds = word_spans(_FOLD[data], offsets, _BREAKS)
            texts = part.column("text").to_pylist()
            for row, spans in enumerate(part.column("_spans").to_pylist()):
                if spans:
                    kept, at = [], offsets[row]
                    for first, last in zip(spans[::2], spans[1::2], strict=True):
                        kept.append(data[at : starts[bounds[row] + first]].tobytes())
                        at = ends[bounds[row] + last - 1]
                    kept.append(data[at : offsets[row + 1]].tobytes())
                    texts[row] = b"".join(kept).decode()
            yield {name: part.column(name) for name in names} | {"text": texts}

    return map_batches(docs, cut, _schema(docs))


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
