"""Line deduplication: a line that several documents hold stays in the one with the smallest doc_id.

A first scan fills two Bloom filters (``seen_twice``).  A second scan looks every line up in the filter of
keys seen twice; only lines found there are shuffled, compared by their whole key, and given their first
document.  Lines of a key are spread over salts, so a line that a third of all documents hold is split.

Defined cases: a null or empty text is one empty line; null doc_ids count as one document after all
others; rows with the same doc_id are one document; a column of ``docs`` with the name of a result is
replaced; all other columns, whatever their names, come back unchanged.  ``text`` becomes the kept lines (null stays null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.batches import SPACES, fresh_name, map_batches, mix, rows_of, slices, utf8, word_hashes
from sitequarry.llm.seen_twice import SeenTwice, log_bits, seen_twice
from sitequarry.operators.lineage import Workspace

_LAST = 2**63 - 1
RESULTS = ("n_lines", "n_dropped")

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


class Lines:
    """The keys of all lines of some texts: without white space at the ends, A-Z in lower case."""

    def __init__(self, texts: pa.Array, min_chars: int):
        data, offsets = utf8(texts)
        self.data = data = _FOLD[data]
        breaks = np.flatnonzero(data == 0x0A)
        starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([breaks, offsets[1:]]))
        bounds = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
        solid = np.append(np.flatnonzero(~SPACES[data]), len(data))
        first = solid[np.searchsorted(solid, starts)]
        last = solid[np.searchsorted(solid, ends) - 1] + 1 if len(data) else ends
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        some = (first < ends) & (last > starts)
        first, last = np.where(some, first, starts), np.where(some, last, starts)
        at = np.flatnonzero(chars[last] - chars[first] >= min_chars)
        self.starts, self.ends = first[at], last[at]
        self.rows = rows_of(at, bounds)
        self.numbers = at - bounds[self.rows]
        self.hashes = word_hashes(data, self.starts, self.ends)

    def distinct(self) -> np.ndarray:
        """The hashes, once per row."""
        with_row = mix(self.hashes + self.rows.astype(np.uint64))
        return self.hashes[np.unique(with_row, return_index=True)[1]]

    def keys(self, which: np.ndarray) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[which], self.ends[which], strict=True)]


def count_lines(text: Column) -> Column:
    """How many lines a text has."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def dedup_lines(docs: DataFrame, workspace: Workspace, min_chars: int = 10) -> DataFrame:
    """``docs`` with repeated lines of at least ``min_chars`` code points dropped from all but one
    document; adds n_lines (before) and n_dropped."""
    docs = docs.drop(*RESULTS)
    texts = docs.select(
        F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("version"), "text"
    )

    def hashes_of(batch: pa.RecordBatch):
        for part in slices(batch):
            yield Lines(part.column("text"), min_chars).distinct()

    size = log_bits(docs.agg(F.sum(count_lines(F.col("text")))).first()[0] or 0)
    segments = workspace.table(seen_twice(docs.select("text"), hashes_of, size), "seen_twice")
    known = workspace.spark.sparkContext.broadcast(SeenTwice(segments, size))

    def probe(batch: pa.RecordBatch):
        for part in slices(batch):
            lines = Lines(part.column("text"), min_chars)
            found = np.flatnonzero(known.value.suspects(lines.hashes))
            rows = pa.array(lines.rows[found])
            yield {
                "doc": part.column("doc").take(rows),
                "version": part.column("version").take(rows),
                "line": lines.numbers[found],
                "key": pa.array(lines.keys(found), pa.binary()),
            }

    suspects = map_batches(texts, probe, "doc long, version long, line int, key binary")
    suspects = workspace.table(suspects, "suspects")
    salts = int(workspace.spark.conf.get("spark.sql.shuffle.partitions"))
    salted = suspects.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)))
    by_salt = salted.groupBy("key", "salt").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    repeated = (
        by_salt.groupBy("key")
        .agg(F.min("low").alias("first"), F.max("high").alias("last"))
        .filter("first < last")
        .select("key", "first")
    )
    # At most one row per key and salt on the right, so no group of this join is large.
    first = by_salt.select("key", "salt").join(repeated, "key")
    # Names of the caller's columns are never reused for helpers, so every column of ``docs`` comes back as it was.
    taken = set(docs.columns)
    doc, version, dropped = (fresh_name(name, taken) for name in ("doc", "version", "drop"))
    drops = (
        salted.join(first, ["key", "salt"])
        .filter("doc > first")
        .groupBy(F.col("doc").alias(doc), F.col("version").alias(version))
        .agg(F.collect_set("line").alias(dropped))
    )
    drop = F.coalesce(dropped, F.array().cast("array<int>"))
    row_lines = F.split("text", "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(row_lines) - 1), drop)
    kept = F.array_join(F.transform(stays, lambda i: F.get(row_lines, i)), "\n")
    return (
        docs.withColumns(
            {
                doc: F.coalesce("doc_id", F.lit(_LAST)),
                version: F.xxhash64("text"),
                "n_lines": F.coalesce(count_lines(F.col("text")), F.lit(1)).cast("long"),
            }
        )
        .join(drops, [doc, version], "left")
        .withColumns(
            {
                "n_dropped": F.size(drop).cast("long"),
                "text": F.when(F.size(drop) > 0, kept).otherwise(F.col("text")),
            }
        )
        .select(*docs.columns, *RESULTS)
    )

