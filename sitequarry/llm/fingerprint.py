"""Context-triggered piecewise hashing: fingerprints that stay alike when a text is edited.

A hash of the last WINDOW bytes ends a piece where it is one less than a multiple of the block size; each piece
gives one character.  Block sizes are 3 * 2**i.  A text's size is the smallest that expects at most LENGTH
pieces, halved while fewer than LENGTH / 2 are found, and a fingerprint holds the signatures for that size
and its double, so texts whose sizes differ by one step can be compared.  Pieces after the last that fits are
joined to it, so all of a text counts.

Defined cases: a null text is empty, and an empty text has empty signatures, alike only to each other;
rows that share a doc_id are neighbours, in an order that depends on their texts; a column of ``docs`` with the
name of a result is replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.batches import SLICE_BYTES, map_batches, map_partitions, mix, slices, utf8

WINDOW = 7
LENGTH = 64
LEVELS = 28
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_KEYS = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_FACTOR = np.uint32(0x9E3779B1)
_FIRST = -(2**63)


def _rolling(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes that end at each place, or of fewer at a text's start."""
    keys = _KEYS[data]
    rolling = keys.copy()
    for back in range(1, WINDOW):
        factor = _FACTOR ** np.uint32(back)
        rolling[back:] += keys[:-back] * factor
        # What reached over a text's start is taken back.
        for place in range(back):
            at = (offsets[:-1] + place)[offsets[1:] - offsets[:-1] > place]
            at = at[at >= back]
            rolling[at] -= keys[at - back] * factor
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x85EBCA6B)
    rolling ^= rolling >> np.uint32(13)
    return rolling


def _signatures(sums: np.ndarray, at: np.ndarray, owner: np.ndarray, offsets: np.ndarray) -> list[str]:
    """One character per piece of each text; ``at`` are the places that end pieces."""
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    number = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = number < LENGTH - 1
    at, owner = at[kept], owner[kept]
    # The rest of a text is a piece too.
    some = np.flatnonzero(np.diff(offsets))
    ends = np.concatenate([at + 1, offsets[1:][some]])
    owner = np.concatenate([owner, some])
    order = np.lexsort((ends, owner))
    ends, owner = ends[order], owner[order]
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    starts[new] = offsets[:-1][owner[new]]
    full = starts < ends
    starts, ends, owner = starts[full], ends[full], owner[full]
    pieces = _ALPHABET[(mix(sums[ends] - sums[starts]) >> np.uint64(58)).astype(np.int64)].tobytes()
    cuts = np.searchsorted(owner, np.arange(n + 1)).tolist()
    return [pieces[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def fingerprints(texts: pa.Array) -> list[str]:
    """``size:signature:signature at double size`` of each text."""
    data, offsets = utf8(texts)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    rolling = _rolling(data, offsets)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(rolling.astype(np.uint64)))])
    last = rolling + np.uint32(1)
    at = np.flatnonzero((last % np.uint32(3) == 0) & (last != 0))
    last = last[at]
    level = np.minimum(np.bitwise_count((last & -last) - np.uint32(1)).astype(np.int64), LEVELS - 1)
    owner = np.repeat(np.arange(n), sizes)[at]
    by_level = np.bincount(owner * LEVELS + level, minlength=n * LEVELS).reshape(n, LEVELS)
    enough = np.cumsum(by_level[:, ::-1], axis=1)[:, ::-1] + 1 >= LENGTH // 2
    start = np.ceil(np.log2(np.maximum(sizes, 1) / (3 * LENGTH))).clip(0, LEVELS - 2).astype(np.int64)
    allowed = enough & (np.arange(LEVELS) <= start[:, None])
    chosen = np.where(allowed.any(axis=1), LEVELS - 1 - allowed[:, ::-1].argmax(axis=1), 0)
    one, two = (level >= chosen[owner] + step for step in (0, 1))
    first = _signatures(sums, at[one], owner[one], offsets)
    second = _signatures(sums, at[two], owner[two], offsets)
    return [f"{3 << c}:{a}:{b}" for c, a, b in zip(chosen.tolist(), first, second, strict=True)]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with fingerprint."""
    docs = docs.drop("fingerprint")
    names = docs.columns

    def compute(batch: pa.RecordBatch):
        for part in slices(batch):
            yield {n: part.column(n) for n in names} | {"fingerprint": fingerprints(part.column("text"))}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, compute, f"{kinds}, fingerprint string")


def likeness(a: str, b: str) -> Column:
    """0 to 1: one less the edit distance of signatures for a common block size, over the longer's length;
    0 if there is no common size."""
    left, right = F.split(a, ":"), F.split(b, ":")
    size = lambda parts: parts[0].cast("long")

    def like(x: Column, y: Column) -> Column:
        longer = F.greatest(F.length(x), F.length(y))
        return F.when(longer == 0, 0.0).otherwise(1 - F.levenshtein(x, y) / longer)

    return (
        F.when(F.col(a) == F.col(b), 1.0)
        .when(size(left) == size(right), F.greatest(like(left[1], right[1]), like(left[2], right[2])))
        .when(size(left) == 2 * size(right), like(left[1], right[2]))
        .when(2 * size(left) == size(right), like(left[2], right[1]))
        .otherwise(0.0)
    )


def edited(text: str, following: str) -> str:
    """A text whose last third is replaced by the beginning of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULTS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) of each row of
    ``docs``, where the next document is the one with the next smaller doc_id, and the largest after the last.

    Rows are dealt to ranges of doc_id and sorted there; each range also gets the first row of the range after it.
    """
    spark = docs.sparkSession
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        "doc_id",
        "text",
        F.coalesce("doc_id", F.lit(_FIRST)).alias("key"),
        F.xxhash64("text").alias("tie"),
    )
    shares = [i / n_ranges for i in range(1, n_ranges)]
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", shares, 0.25 / n_ranges)}) if shares else []
    above = F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda x: x > F.col("key"))
    keyed = keyed.withColumn("range", F.size(above))
    # One row per range: its first, which the range before it needs as a next document.
    firsts = keyed.groupBy("range").agg(F.max(F.struct("key", "tie")).alias("first")).orderBy("range").collect()
    ranges = [r["range"] for r in firsts]
    wanted = [(*row["first"], ranges[i - 1]) for i, row in enumerate(firsts)]
    wanted = spark.createDataFrame(wanted, "key bigint, tie bigint, target int")
    ends = keyed.join(F.broadcast(wanted), ["key", "tie"]).select(
        "doc_id", "text", "key", "tie", F.col("target").alias("range"), F.lit(True).alias("ends")
    )
    dealt = (
        keyed.withColumn("ends", F.lit(False))
        .unionByName(ends)
        .repartitionById(n_ranges, F.col("range"))
        .sortWithinPartitions("range", "ends", F.desc("key"), F.desc("tie"))
        .select("doc_id", "text", "range", "ends")
    )
    kind = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint")),
        ]
    )

    def run(batches):
        held = None  # the last row, until its next is known
        for batch in batches:
            for part in slices(batch):
                ids, ends = (part.column(c).to_pylist() for c in ("doc_id", "ends"))
                texts = [t or "" for t in part.column("text").to_pylist()]
                prints = fingerprints(part.column("text"))
                rows = list(zip(ids, texts, prints, ends, strict=True))
                rows = [held, *rows] if held else rows
                held = None if rows[-1][3] else rows[-1]
                # A row that ends a range is only a next document, and may be there twice if it is repeated.
                pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3]]
                for at in _chunks([len(a[1]) for a, _ in pairs]):
                    some = pairs[at]
                    changed = [edited(a[1], b[1]) for a, b in some]
                    columns = [
                        [a[0] for a, _ in some],
                        [len(a[1]) for a, _ in some],
                        [hashlib.sha256(t.encode()).hexdigest() for t in changed],
                        [a[2] for a, _ in some],
                        fingerprints(pa.array(changed, pa.large_string())),
                        [b[2] for _, b in some],
                    ]
                    arrays = [pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=kind)

    return map_partitions(dealt, run, f"doc_id bigint, {RESULTS}")


def _chunks(sizes: list[int]):
    """Slices of a list whose sizes sum to about SLICE_BYTES."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        total += size
        if total >= SLICE_BYTES:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))
