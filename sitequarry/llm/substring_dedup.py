"""Substring deduplication: words inside a window of ``size`` words that occurs anywhere else are removed.

Comparing every document with an index of every shard would be quadratic, so equal windows are brought
together first.  In each window the run of ANCHOR words with the smallest hash is its anchor; equal windows
have equal anchors.  Neighbouring windows with the same anchor form a segment, and only segments whose
anchor occurs more than once can hold a repeated window.  Equal segments are counted and kept once.
Segments are dealt to shards by anchor; each shard builds an FM-index over its segments and streams them
past it: backward search gives the matching statistics, and windows that match twice are reported.
An anchor with more than HOT_SEGMENTS different segments is split: its windows are counted by their
whole content instead.

Segments travel as text with single spaces, which is half the size of hashes once compressed.  Within a shard
words are told apart by 64-bit hashes, so two windows are confused only if words at the same places have
equal hashes.

Defined cases: a null text has no words; texts shorter than a window stay; rows that repeat a doc_id and
text are repeats of one another; null doc_ids are told apart by their text; a column of ``docs`` with the name
of a result is replaced; all other columns, whatever their names, come back unchanged.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.batches import (
    SPACES,
    fresh_name,
    map_batches,
    map_partitions,
    rows_of,
    slices,
    utf8,
    window_hashes,
    window_starts,
    word_hashes,
    word_spans,
)
from sitequarry.llm.fm_index import FMIndex
from sitequarry.operators.lineage import Workspace

WINDOW = 35
ANCHOR = 8
#: Words of distinct segments that one shard's index is built over.
SHARD_WORDS = 500_000
HOT_SEGMENTS = 2_000
#: About what a word and a space take up; it only decides how many shards there are.
WORD_BYTES = 6
#: Digests a task remembers to give equal segments' words once.
SEEN_SEGMENTS = 500_000
_KEY = ["doc", "version"]
_ONE_SPACE = bytes(0x20 if SPACES[b] else b for b in range(256))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each position with ``width`` values from there on: where the smallest is, leftmost on ties."""
    best, at, have = values, np.arange(len(values)), 1
    while have < width and len(best):
        step = min(have, width - have)
        right = best[step:] < best[:-step]
        best = np.where(right, best[step:], best[:-step])
        at = np.where(right, at[step:], at[:-step])
        have += step
    return at


def _words(texts: pa.Array):
    data, offsets = utf8(texts)
    starts, ends, bounds = word_spans(data, offsets)
    return word_hashes(data, starts, ends), bounds


def find_anchors(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, doc, version, start, windows) of all segments of ``docs`` (doc, version, text)."""

    def find(batch: pa.RecordBatch):
        for part in slices(batch):
            words, bounds = _words(part.column("text"))
            grams = window_hashes(words, ANCHOR)
            at = window_starts(bounds, size)
            if not len(at):
                continue
            places = leftmost_minima(grams, size - ANCHOR + 1)[at]
            new = np.flatnonzero(np.diff(places, prepend=-1))
            rows = rows_of(at[new], bounds)
            yield {
                "anchor": grams[places[new]].view(np.int64),
                "doc": part.column("doc").take(pa.array(rows)),
                "version": part.column("version").take(pa.array(rows)),
                "start": at[new] - bounds[rows],
                "windows": np.diff(new, append=len(at)),
            }

    kinds = "anchor bigint, doc bigint, version int, start int, windows int"
    return map_batches(docs, find, kinds)


def _segments(docs: DataFrame, size: int) -> DataFrame:
    """The segments that ``docs`` lists in ``segments``; a task gives the words (as text with single
    spaces) of equal segments once, and null for the others."""
    kind = pa.schema(
        [
            ("anchor", pa.int64()),
            ("digest", pa.binary()),
            ("doc", pa.int64()),
            ("version", pa.int32()),
            ("start", pa.int32()),
            ("words", pa.binary()),
        ]
    )

    def cut(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch):
                data, offsets = utf8(part.column("text"))
                begins, ends, bounds = word_spans(data, offsets)
                wide = np.concatenate([[0], np.cumsum(begins[1:] - ends[:-1] != 1)])
                rows, anchors, starts, digests, texts = [], [], [], [], []
                for row, segments in enumerate(part.column("segments").to_pylist()):
                    for s in segments:
                        first = int(bounds[row]) + s["start"]
                        last = first + s["windows"] + size - 2
                        text = data[begins[first] : ends[last]].tobytes().translate(_ONE_SPACE)
                        if wide[last] > wide[first]:
                            text = b" ".join(text.split())
                        digest = hashlib.blake2b(text, digest_size=16).digest()
                        rows.append(row)
                        anchors.append(s["anchor"])
                        starts.append(s["start"])
                        digests.append(digest)
                        texts.append(None if digest in seen else text)
                        seen.add(digest)
                if len(seen) > SEEN_SEGMENTS:
                    seen = set()
                at = pa.array(rows, pa.int64())
                columns = [anchors, digests, part.column("doc").take(at), part.column("version").take(at)]
                columns += [starts, texts]
                arrays = [
                    c if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for c, f in zip(columns, kind, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=kind)

    kinds = "anchor bigint, digest binary, doc bigint, version int, start int, words binary"
    return map_partitions(docs, cut, kinds)


def _split_windows(segments: DataFrame, size: int) -> DataFrame:
    """One row per window of each segment."""

    def split(batch: pa.RecordBatch):
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows, digests, offsets = [], [], []
            for row, words in enumerate(part.column("words").to_pylist()):
                words = words.split(b" ")
                for i in range(len(words) - size + 1):
                    window = b" ".join(words[i : i + size])
                    rows.append(row)
                    offsets.append(i)
                    digests.append(hashlib.blake2b(window, digest_size=16).digest())
            taken = {
                n: part.column(n).take(pa.array(rows, pa.int64())) for n in ("anchor", "digest", "n")
            }
            yield taken | {"window": digests, "offset": offsets}

    kinds = "anchor bigint, digest binary, n bigint, window binary, offset int"
    return map_batches(segments, split, kinds)


def repeated_spans(texts: list[np.ndarray], counts: np.ndarray, size: int) -> list[list[int]]:
    """Spans of words [start, end, ...] of the texts (different ones, with how often each occurs) that
    lie in windows occurring more than once among them."""
    lengths = np.array([len(t) for t in texts])
    single = np.flatnonzero(counts < 2)
    spans = [[0, len(t)] for t in texts]
    if not len(single):
        return spans
    first = np.cumsum(lengths + 1) - lengths - 1
    ids = np.zeros(int(lengths.sum()) + len(texts), np.int64)
    inside = np.ones(len(ids), bool)
    inside[first + lengths] = False
    ids[inside] = np.unique(np.concatenate(texts), return_inverse=True)[1] + 1
    index = FMIndex(ids, int(lengths.max()))
    # The longest match at a text's end settles all windows within it.
    tails = index.matching_statistics(ids, first[single] + lengths[single] - 1, lengths[single])
    open_ends = np.maximum(np.where(tails >= size, lengths[single] - tails, lengths[single] - size + 1), 0)
    total = int(open_ends.sum())
    owner = np.repeat(np.arange(len(single)), open_ends)
    begins = np.arange(total) - np.repeat(np.cumsum(open_ends) - open_ends, open_ends)
    ends = first[single][owner] + begins + size - 1
    hit = index.matching_statistics(ids, ends, np.full(total, size)) >= size
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, ends[hit] - size + 1, 1)
    np.add.at(change, ends[hit] + 1, -1)
    long = tails >= size
    stops = first[single] + lengths[single]
    np.add.at(change, (stops - tails)[long], 1)
    np.add.at(change, stops[long], -1)
    edges = np.flatnonzero(np.diff(np.cumsum(change[:-1]) > 0, prepend=False, append=False))
    cuts = np.searchsorted(edges, np.stack([first[single], stops], axis=1))
    for i, (a, b) in zip(single.tolist(), cuts.tolist(), strict=True):
        # A span that ends with the text has its edge at the separator.
        b += int((b - a) % 2)
        spans[i] = (edges[a:b] - first[i]).tolist()
    return spans


def _match(segments: DataFrame, n_shards: int, size: int) -> DataFrame:
    """(anchor, digest, spans) of the segments that hold repeated windows."""
    kind = pa.schema([("anchor", pa.int64()), ("digest", pa.binary()), ("spans", pa.list_(pa.int32()))])

    def match(batches):
        held, words, last = [], 0, None

        def shard():
            data, offsets = utf8(pa.array([w for _, _, w, _ in held], pa.large_binary()))
            starts, ends, bounds = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends)
            texts = [hashes[a:b] for a, b in pairwise(bounds.tolist())]
            spans = repeated_spans(texts, np.array([n for *_, n in held]), size)
            found = [(a, d, s) for (a, d, *_), s in zip(held, spans, strict=True) if s]
            columns = list(zip(*found, strict=True)) or [[], [], []]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=kind)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("anchor", "digest", "words", "n")]
            for row in zip(*columns, strict=True):
                if words > SHARD_WORDS and row[0] != last:
                    yield shard()
                    held, words = [], 0
                held.append(row)
                words += row[2].count(b" ") + 1
                last = row[0]
        if held:
            yield shard()

    dealt = segments.repartition(n_shards, "anchor").sortWithinPartitions("anchor")
    return map_partitions(dealt, match, "anchor bigint, digest binary, spans array<int>")


def find_repeats(docs: DataFrame, workspace: Workspace, size: int = WINDOW) -> DataFrame:
    """``docs`` with removed, the spans of words [start, end, ...] that repeated windows cover."""
    if size < ANCHOR:
        raise ValueError(f"a window has at least {ANCHOR} words")
    docs = docs.drop("removed")
    # The key columns get names no caller's column has; inside, the narrow tables use doc and version.
    taken = set(docs.columns)
    doc, version = fresh_name("doc", taken), fresh_name("version", taken)
    keyed = docs.withColumns(
        {doc: F.coalesce("doc_id", F.xxhash64("text")), version: F.hash("text", "doc_id")}
    )
    texts = keyed.select(F.col(doc).alias("doc"), F.col(version).alias("version"), "text")
    anchors = workspace.table(find_anchors(texts, size), "anchors", "zstd")
    # Written, so that both sides of the join are plain exchanges and a frequent anchor can be split.
    repeated = anchors.groupBy("anchor").count().filter("count > 1").select("anchor")
    repeated = workspace.table(repeated, "repeated")
    wanted = (
        anchors.join(repeated, "anchor")
        .groupBy(*_KEY)
        .agg(F.collect_list(F.struct("anchor", "start", "windows")).alias("segments"))
    )
    # Rows alike in doc_id and text list the same segments twice over; each row yields them once.
    wanted = wanted.withColumn("segments", F.array_distinct("segments"))
    segments = workspace.table(_segments(texts.join(wanted, _KEY), size), "segments", "zstd")
    distinct = workspace.table(
        segments.groupBy("anchor", "digest").agg(
            F.first("words", ignorenulls=True).alias("words"), F.count(F.lit(1)).alias("n")
        ),
        "distinct",
        "zstd",
    )
    hot = distinct.groupBy("anchor").count().filter(F.col("count") > HOT_SEGMENTS).select("anchor")
    hot = workspace.table(hot, "hot")
    windows = workspace.table(_split_windows(distinct.join(hot, "anchor"), size), "windows")
    often = windows.groupBy("window").agg(F.sum("n").alias("n")).filter("n > 1").select("window")
    split = (
        windows.join(often, "window")
        .groupBy("anchor", "digest")
        .agg(F.flatten(F.collect_list(F.array("offset", F.col("offset") + size))).alias("spans"))
    )
    calm = distinct.join(hot, "anchor", "left_anti")
    n_words = (calm.agg(F.sum(F.octet_length("words"))).first()[0] or 0) / WORD_BYTES
    n_shards = max(math.ceil(n_words / SHARD_WORDS), int(workspace.spark.sparkContext.defaultParallelism))
    matched = workspace.table(_match(calm, n_shards, size), "matched")
    hits = (
        segments.select("anchor", "digest", *_KEY, "start")
        .join(matched.unionByName(split), ["anchor", "digest"])
        .groupBy(*_KEY)
        .agg(
            F.flatten(F.collect_list(F.transform("spans", lambda p: p + F.col("start")))).alias("removed")
        )
    )
    hits = hits.select(F.col("doc").alias(doc), F.col("version").alias(version), "removed")
    return keyed.join(hits, [doc, version], "left").select(*docs.columns, "removed")


def remove_repeats(docs: DataFrame, workspace: Workspace, size: int = WINDOW) -> DataFrame:
    """``docs`` with the words in repeated windows removed: ``text`` becomes the kept words, joined by one
    space; adds n_words (before), n_removed, and kept_sha256 of that text."""
    results = {"n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    found = find_repeats(docs.drop(*results), workspace, size)
    names = [c for c in found.columns if c not in ("text", "removed")]

    def remove(batch: pa.RecordBatch):
        for part in slices(batch):
            texts, totals, gone, digests = [], [], [], []
            for text, spans in zip(
                part.column("text").to_pylist(), part.column("removed").to_pylist(), strict=True
            ):
                words = (text or "").encode().split()
                keep = np.ones(len(words), bool)
                for start, end in zip(spans[::2], spans[1::2], strict=True) if spans else ():
                    keep[start:end] = False
                kept = b" ".join(compress(words, keep))
                texts.append(kept)
                totals.append(len(words))
                gone.append(len(words) - int(keep.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield {n: part.column(n) for n in names} | {
                "text": pa.array(texts, pa.binary()),
                "n_words": totals,
                "n_removed": gone,
                "kept_sha256": digests,
            }

    kinds = {f.name: f.dataType.simpleString() for f in found.schema if f.name in names}
    schema = ", ".join(f"`{n}` {k}" for n, k in (kinds | {"text": "string"} | results).items())
    return map_batches(found, remove, schema)
