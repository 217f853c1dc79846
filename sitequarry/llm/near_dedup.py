"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF weighted shingles.

1. Document frequencies of all shingles (five words) are counted in a table of 2**DF_BITS hashed cells.
2. A shingle weighs (1 + ln tf) * (1 + IDF_SHARE * ln(N / df) / ln N).  The share is small, as a high one would
   let the few words in which two copies differ outweigh the many that a large group of copies has made
   frequent.  Each text gets BANDS * ROWS consistent samples; texts with an equal band share a bucket.
3. Equal texts are one node from here on.  Each node of a bucket is compared with the bucket's pivot by weighted
   Jaccard similarity; links of THRESHOLD or more give components.  The pivot is the node whose shingles are the
   most frequent on average: among copies with edits, the one with the fewest.
4. Where a bucket still has several components, nodes of different ones are compared too, unless their distances
   to the pivot differ by more than a link allows (the distance is a metric), or their weights do: two texts
   have in common at most the sum of the smaller of their weights in each of BOUND_CELLS hashed cells.  Both
   bounds are exact, so no link of a bucket is lost.
5. Components of all links are the classes.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case; a text of fewer than five
words is one shingle.  Defined cases: texts without words are only like equal texts; null counts as empty;
rows that share a doc_id are one document and go together if their texts are equal; class_id is the least
doc_id of a class, null if it has none; a column of ``docs`` with the name of a result is replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.batches import (
    map_batches,
    mix,
    rows_of,
    slices,
    small_batches,
    utf8,
    window_hashes,
    window_starts,
    word_hashes,
    word_spans,
)
from sitequarry.llm.cells import sum_cells
from sitequarry.llm.components import components
from sitequarry.operators.lineage import Workspace

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 14, 4
#: Weight sums a node travels with, as 16-bit multiples of its own unit, rounded up.
BOUND_CELLS, UNITS = 512, 32000
IDF_SHARE = 0.1
DF_BITS = 18
#: A pair carries two vectors, so few of them go to Python at once.
PAIRS_PER_BATCH = 200

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order: hashes, how often each occurs, and bounds by row."""
    data, offsets = utf8(texts)
    data = _FOLD[data]
    starts, ends, bounds = word_spans(data, offsets, _BREAKS)
    words = word_hashes(data, starts, ends)
    grams, at = window_hashes(words, SHINGLE), window_starts(bounds, SHINGLE)
    rows, hashes = rows_of(at, bounds), grams[at]
    counts = np.diff(bounds)
    for n in range(1, SHINGLE):  # short texts as a whole
        some = np.flatnonzero(counts == n)
        if len(some):
            rows = np.concatenate([rows, some])
            hashes = np.concatenate([hashes, window_hashes(words, n)[bounds[some]]])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(first, append=len(rows))
    return hashes[first], tf, np.searchsorted(rows[first], np.arange(len(texts) + 1))


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)


def document_frequencies(texts: DataFrame, workspace: Workspace) -> tuple[np.ndarray, int]:
    """How many documents have a shingle in each of the 2**DF_BITS cells, and how many documents there are."""

    def count(batch: pa.RecordBatch):
        for part in slices(batch):
            yield "", np.bincount(cells(shingles(part.column("text"))[0]), minlength=1 << DF_BITS)

    found = sum_cells(texts.select("text"), count, 1 << DF_BITS, workspace)
    return found.get("", np.zeros(1 << DF_BITS, np.int64)), texts.count()


def idf_factors(frequencies: np.ndarray, n: int) -> np.ndarray:
    share = np.log(max(n, 2) / np.clip(frequencies, 1, max(n, 1))) / np.log(max(n, 2))
    return (1 + IDF_SHARE * share).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: sample j of a weighted set is the pair (k, t) of an element and
    a level that two sets share with a chance equal to their weighted Jaccard similarity."""

    def __init__(self, n: int, seed: int, uniform_bits: int):
        rng = np.random.default_rng(seed)
        self.drop = np.uint32(32 - uniform_bits)
        self.step = np.float32(2.0**-uniform_bits)
        self.keys = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _uniform(self, bits: np.ndarray) -> np.ndarray:
        """Numbers between 0 and 1, without the ends, from the upper ones of 32 bits."""
        return ((bits >> self.drop).view(np.int32).astype(np.float32) + np.float32(0.5)) * self.step

    def _numbers(self, hashes: np.ndarray, key: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each element's own r and c, of gamma distributions with shape 2, and uniform beta, from its hash."""
        x = hashes * key
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        y = x * np.uint64(0x94D049BB133111EB)
        y ^= y >> np.uint64(32)
        z = y * np.uint64(0x9E3779B97F4A7C15)
        x, y, z = x.view(np.uint32), y.view(np.uint32), z.view(np.uint32)
        r = -np.log(self._uniform(x[0::2]) * self._uniform(x[1::2]))
        c = -np.log(self._uniform(y[0::2]) * self._uniform(y[1::2]))
        return r, c, self._uniform(z[1::2])

    def samples(self, hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """One row of 64-bit samples for each set; every set has an element."""
        logs = np.log(weights)
        first = bounds[:-1]
        place = np.arange(len(hashes), dtype=np.int64)
        found = np.empty((len(first), len(self.keys)), np.uint64)
        for j, key in enumerate(self.keys):
            r, c, beta = self._numbers(hashes, key)
            t = np.floor(logs / r + beta)
            rank = (np.log(c) - r * (t - beta + 1)).view(np.int32).astype(np.int64)
            # Floats as integers of the same order, with the element's place below for the minimum to carry.
            rank = ((rank ^ ((rank >> 31) & 0x7FFFFFFF)) << 32) | place
            least = np.minimum.reduceat(rank, first) & 0xFFFFFFFF
            found[:, j] = mix(hashes[least] + t[least].astype(np.int64).view(np.uint64) + key)
        return found


@lru_cache(maxsize=1)
def sampler() -> Sampler:
    """The process's sampler for bands, the same everywhere."""
    return Sampler(BANDS * ROWS, 7, 23)


def _weights(hashes: np.ndarray, tf: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf.astype(np.float32))) * factors[cells(hashes)]


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _sign(texts: DataFrame, factors) -> DataFrame:
    """(doc_id, node, rarity, buckets) of ``texts`` (doc_id, node, text)."""

    def sign(batch: pa.RecordBatch):
        for part in slices(batch):
            hashes, tf, bounds = shingles(part.column("text"))
            some = np.flatnonzero(np.diff(bounds))
            buckets = [None] * part.num_rows
            rarity = np.zeros(part.num_rows)
            if len(some):
                used = np.append(bounds[:-1][some], bounds[-1])
                sums = np.add.reduceat(factors.value[cells(hashes)], used[:-1], dtype=np.float64)
                rarity[some] = sums / np.diff(used)
                found = sampler().samples(hashes, _weights(hashes, tf, factors.value), used)
                bands = found.reshape(len(some), BANDS, ROWS)
                keys = np.zeros((len(some), BANDS), np.uint64)
                for i in range(ROWS):
                    keys = mix(keys + bands[:, :, i] + np.arange(BANDS, dtype=np.uint64))
                for row, own in zip(some.tolist(), keys.view(np.int64).tolist(), strict=True):
                    buckets[row] = own
            yield {
                "doc_id": part.column("doc_id"),
                "node": part.column("node"),
                "rarity": rarity,
                "buckets": buckets,
            }

    kinds = "doc_id bigint, node binary, rarity double, buckets array<bigint>"
    return map_batches(texts, sign, kinds)


def cell_sums(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Total weight of each set, its unit, and its weight in each cell in units, rounded up; every set has an
    element."""
    n = len(bounds) - 1
    at = rows_of(np.arange(len(hashes)), bounds) * BOUND_CELLS
    at += (hashes >> np.uint64(40)).astype(np.int64) % BOUND_CELLS
    sums = np.bincount(at, weights, n * BOUND_CELLS).reshape(n, BOUND_CELLS)
    units = sums.max(axis=1) / UNITS
    return sums.sum(axis=1), units, np.ceil(sums / units[:, None]).astype(np.int16)


def _sums(vectors: DataFrame) -> DataFrame:
    """(node, total, unit, sums) of ``vectors``."""

    def add(batch: pa.RecordBatch):
        for part in slices(batch, "hashes"):
            hashes = [np.frombuffer(h.as_py(), np.uint64) for h in part.column("hashes")]
            weights = [np.frombuffer(w.as_py(), "<f4") for w in part.column("weights")]
            bounds = np.cumsum([0, *map(len, hashes)])
            total, unit, sums = cell_sums(np.concatenate(hashes), np.concatenate(weights), bounds)
            yield {"node": part.column("node"), "total": total, "unit": unit, "sums": list(sums)}

    return map_batches(vectors, add, "node binary, total double, unit double, sums array<smallint>")


def _vectors(texts: DataFrame, factors) -> DataFrame:
    """(node, hashes, weights) of ``texts`` (node, text), as packed numbers."""

    def pack(batch: pa.RecordBatch):
        for part in slices(batch):
            hashes, tf, bounds = shingles(part.column("text"))
            weights = _weights(hashes, tf, factors.value).astype("<f4")
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield {
                "node": part.column("node"),
                "hashes": [hashes[a:b].tobytes() for a, b in spans],
                "weights": [weights[a:b].tobytes() for a, b in spans],
            }

    return map_batches(texts, pack, "node binary, hashes binary, weights binary")


def weighted_jaccard(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Similarity of two packed vectors: the sum of smaller weights over the sum of larger ones."""
    (ha, wa), (hb, wb) = ((np.frombuffer(h, np.uint64), np.frombuffer(w, "<f4")) for h, w in (a, b))
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    common = float(np.minimum(wa[i], wb[j]).sum(dtype=np.float64))
    total = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - common
    return common / total if total else 0.0


def _compare(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with their similarity."""
    left = vectors.toDF("a", "ha", "wa")
    right = vectors.toDF("b", "hb", "wb")

    def compare(batch: pa.RecordBatch):
        columns = [batch.column(c) for c in ("ha", "wa", "hb", "wb")]
        found = []
        for row in range(batch.num_rows):
            ha, wa, hb, wb = (c[row].as_py() for c in columns)
            found.append(weighted_jaccard((ha, wa), (hb, wb)))
        yield {"a": batch.column("a"), "b": batch.column("b"), "similarity": found}

    # The pair side may repeat a node very often; Spark splits such partitions of a sort-merge join.
    return map_batches(
        pairs.join(left, "a").join(right, "b"), compare, "a binary, b binary, similarity double"
    )


def _most_in_common(a: str, b: str) -> Column:
    """The most weight that two nodes can have in common."""
    unit_a, unit_b = F.col(f"{a}_unit"), F.col(f"{b}_unit")
    smaller = F.zip_with(f"{a}_sums", f"{b}_sums", lambda x, y: F.least(x * unit_a, y * unit_b))
    return F.aggregate(smaller, F.lit(0.0), lambda total, x: total + x)


def near_duplicate_classes(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """(doc_id, node, class_id) for each row of ``docs``; node is the text's digest."""
    texts = docs.select("doc_id", digest(F.col("text")).alias("node"), "text")
    frequencies, n = document_frequencies(texts, workspace)
    factors = workspace.spark.sparkContext.broadcast(idf_factors(frequencies, n))
    signed = workspace.table(_sign(texts, factors), "signed")
    nodes = workspace.table(
        signed.groupBy("node").agg(
            F.min("doc_id").alias("rep"),
            F.first("rarity").alias("rarity"),
            F.first("buckets").alias("buckets"),
        ),
        "nodes",
    )
    members = nodes.select("node", "rarity", F.explode("buckets").alias("bucket"))
    buckets = (
        members.groupBy("bucket")
        .agg(F.min(F.struct("rarity", "node")).alias("pivot"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("bucket", F.col("pivot.node").alias("pivot"))
    )
    members = workspace.table(members.drop("rarity").join(buckets, "bucket"), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    one_text = (texts["node"] == wanted["node"]) & texts["doc_id"].eqNullSafe(wanted["rep"])
    vectors = _vectors(texts.join(wanted, one_text, "left_semi").select("node", "text"), factors)
    vectors = workspace.table(vectors.dropDuplicates(["node"]), "vectors")

    pairs = members.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    with small_batches(workspace.spark, PAIRS_PER_BATCH):
        first = workspace.table(_compare(pairs.distinct(), vectors), "first")
    links = first.filter(F.col("similarity") >= THRESHOLD).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = components(links, workspace)

    placed = workspace.table(_open_members(members, first, found), "open-members")
    still_open = vectors.join(placed.select("node").distinct(), "node", "left_semi")
    sums = workspace.table(_sums(still_open), "sums")
    open_pairs = _open_pairs(placed, sums.join(nodes.select("node", "buckets"), "node"))
    with small_batches(workspace.spark, PAIRS_PER_BATCH):
        more = workspace.table(_compare(open_pairs, vectors), "more")
    links = links.union(more.filter(F.col("similarity") >= THRESHOLD).select("a", "b"))
    found = workspace.table(components(links, workspace), "components")

    named = found.join(nodes.select("node", "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = named.join(least, "component").select("node", "class_id", F.lit(True).alias("linked"))
    by_node = nodes.select("node", "rep").join(classes, "node", "left")
    by_node = by_node.select("node", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("rep")).alias("class_id"))
    return signed.select("doc_id", "node").join(by_node, "node")


def _open_members(members: DataFrame, first: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, node, component, major, distance) of nodes in buckets with several components, without the
    pivots; major is the component with most of the bucket's nodes."""
    distance = first.select(
        F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("similarity")).alias("distance")
    )
    placed = (
        members.join(distance, ["node", "pivot"], "left")
        .join(found, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        sizes.groupBy("bucket")
        .agg(F.max_by("component", "n").alias("major"), F.count(F.lit(1)).alias("parts"))
        .filter("parts > 1")
        .select("bucket", "major")
    )
    return (
        placed.join(mixed, "bucket")
        .filter("node != pivot")
        .select("bucket", "node", "component", "major", "distance")
    )


def _open_pairs(placed: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of nodes that share a bucket, are in different components, and may yet be linked.

    ``known`` is (node, total, unit, sums, buckets).  A pair is met in the least bucket it shares; if one of its
    nodes is the pivot there, it has been compared already.
    """
    placed = placed.join(known, "node")
    left = placed.select("bucket", *[F.col(c).alias(f"l_{c}") for c in placed.columns if c != "bucket"])
    right = placed.filter("component != major").select(
        "bucket", *[F.col(c).alias(f"r_{c}") for c in placed.columns if c != "bucket"]
    )
    # A similarity of THRESHOLD takes so much in common; the factor is for rounding.
    needed = (F.col("l_total") + F.col("r_total")) * (THRESHOLD / (1 + THRESHOLD) * (1 - 1e-6))
    may_link = (
        (F.col("l_component") != F.col("r_component"))
        & ((F.col("l_component") == F.col("l_major")) | (F.col("l_node") < F.col("r_node")))
        & (F.abs(F.col("l_distance") - F.col("r_distance")) <= 1 - THRESHOLD + 1e-6)
        & (F.least("l_total", "r_total") >= needed)
        & (F.array_min(F.array_intersect("l_buckets", "r_buckets")) == F.col("bucket"))
        & (_most_in_common("l", "r") >= needed)
    )
    return (
        left.join(right, "bucket")
        .filter(may_link)
        .select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b"))
        .distinct()
    )


def drop_near_duplicates(docs: DataFrame, workspace: Workspace) -> DataFrame:
    """``docs`` with one document of each class: the one with the least doc_id."""
    classes = near_duplicate_classes(docs, workspace)
    gone = workspace.table(
        classes.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "node").distinct(),
        "gone",
    )
    same = docs["doc_id"].eqNullSafe(gone["doc_id"]) & (digest(docs["text"]) == gone["node"])
    return docs.join(gone, same, "left_anti")
