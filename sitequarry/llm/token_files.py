"""Token files: each shard of documents as one wavelet matrix in one compressed byte string.

Documents are dealt to ranges of doc_id, one task each; every task writes its tokens in shards of about SHARD_TOKENS.
A file holds the shard's alphabet by falling frequency, the bit-planes of the ranks in that alphabet, and the
lengths of its documents.  Frequent tokens have small ranks, so high planes are nearly empty; a block of
a plane is deflated where that makes it smaller.  Files are rows of a Parquet table in shared storage, written
by Spark's committer, so a lost executor leaves no half-written file.

Defined cases: a null or empty text is the end token alone; rows with a null doc_id come first; rows that
share a doc_id are neighbours, in order of their text; no documents give no file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.batches import map_batches, map_partitions, slices
from sitequarry.llm.bpe import encoder
from sitequarry.llm.token_counts import read_spec
from sitequarry.llm.wavelet import BitPlane, WaveletMatrix

MAGIC = b"WMT1"
SHARD_TOKENS = 1 << 20
BLOCK = 4096
_HEAD = "<4sQIIB"


def write_file(ids: np.ndarray, lengths: list[int]) -> bytes:
    """One file of tokens and of how many each document has."""
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    alphabet = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)].astype("<u4")
    n_planes = max(len(alphabet) - 1, 0).bit_length()
    place = np.zeros(len(counts), np.uint16 if n_planes <= 16 else np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    ranks = place[ids]
    parts = [zlib.compress(alphabet.tobytes(), 1), zlib.compress(np.array(lengths, "<u4").tobytes(), 1)]
    for plane in WaveletMatrix.of(ranks, n_planes).planes:
        parts.append(_pack_plane(plane))
    head = struct.pack(_HEAD, MAGIC, len(ids), len(alphabet), len(lengths), n_planes)
    sizes = np.array([len(p) for p in parts], "<u8").tobytes()
    return b"".join([head, sizes, *parts])


def _pack_plane(plane: BitPlane) -> bytes:
    """Blocks of bits, each preceded in a directory by its size; a deflated block is shorter than BLOCK."""
    data = plane.words.tobytes()[: (plane.n + 7) // 8]
    blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
    ones = np.diff(plane.before[:: BLOCK // 8], append=plane.before[-1])
    for i, block in enumerate(blocks):
        # Deflating pays where one bit value is rare.
        share = ones[i] / (8 * len(block))
        if not 0.12 < share < 0.88 and len(small := zlib.compress(block, 1)) < len(block):
            blocks[i] = small
    sizes = np.array([len(b) for b in blocks], "<u2").tobytes()
    return b"".join([struct.pack("<I", len(blocks)), sizes, *blocks])


class TokenFile:
    """Reads a file; a plane is unpacked when it is first needed."""

    def __init__(self, data: bytes):
        magic, self.n, self.n_symbols, n_docs, n_planes = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        first = struct.calcsize(_HEAD)
        sizes = np.frombuffer(data, "<u8", 2 + n_planes, first).astype(np.int64)
        ends = first + 8 * len(sizes) + np.cumsum(sizes)
        parts = [data[end - size : end] for end, size in zip(ends, sizes, strict=True)]
        self.alphabet = np.frombuffer(zlib.decompress(parts[0]), "<u4")
        self.lengths = np.frombuffer(zlib.decompress(parts[1]), "<u4").astype(np.int64)
        if len(self.lengths) != n_docs:
            raise ValueError("damaged token file")
        self.matrix = WaveletMatrix([self._plane(p) for p in parts[2:]], self.n)

    def _plane(self, data: bytes) -> BitPlane:
        (n_blocks,) = struct.unpack_from("<I", data)
        sizes = np.frombuffer(data, "<u2", n_blocks, 4).astype(np.int64)
        ends = 4 + 2 * n_blocks + np.cumsum(sizes)
        whole = (self.n + 7) // 8
        blocks = []
        for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True)):
            block = data[end - size : end]
            full = min(BLOCK, whole - i * BLOCK)
            blocks.append(block if size == full else zlib.decompress(block))
        return BitPlane(np.frombuffer(b"".join(blocks), np.uint8), self.n)

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        if not self.matrix.planes:
            return np.repeat(self.alphabet, self.n)
        return self.alphabet[self.matrix.values(np.uint16 if len(self.matrix.planes) <= 16 else np.uint32)]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The tokens at some positions."""
        return self.alphabet[self.matrix.access(at)]

    def _rank_of(self, token: int) -> int | None:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often a token occurs in a range of positions."""
        rank = self._rank_of(token)
        if rank is None:
            return 0
        before, upto = self.matrix.rank(np.full(2, rank), np.array([start, self.n if end is None else end]))
        return int(upto - before)

    def occurrences(self, token: int) -> np.ndarray:
        """The positions of a token, in order."""
        rank = self._rank_of(token)
        return np.zeros(0, np.int64) if rank is None else self.matrix.locate(rank)


FILES = "part int, shard int, n_tokens bigint, doc_ids array<bigint>, file binary"


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Write the token files of ``docs`` (doc_id, text), in ascending order of doc_id, to ``path``."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    end = np.array([end_id], "<u4").tobytes()
    kind = pa.schema(
        [
            ("part", pa.int32()),
            ("shard", pa.int32()),
            ("n_tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("file", pa.binary()),
        ]
    )

    def write(batches):
        part, shard = TaskContext.get().partitionId(), 0
        held, ids, n = [], [], 0

        def flush():
            lengths = [len(x) // 4 for x in held]
            file = write_file(np.frombuffer(b"".join(held), "<u4"), lengths)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "shard": shard, "n_tokens": n, "doc_ids": ids, "file": file}], schema=kind
            )

        for batch in batches:
            for some in slices(batch):
                texts = [t or "" for t in some.column("text").to_pylist()]
                found = encoder(spec.value).encode(texts)
                for doc_id, tokens in zip(some.column("doc_id").to_pylist(), found, strict=True):
                    held.append(tokens + end)
                    ids.append(doc_id)
                    n += len(held[-1]) // 4
                    if n >= SHARD_TOKENS:
                        yield flush()
                        held, ids, n, shard = [], [], 0, shard + 1
        if held:
            yield flush()

    # Quantiles read doc_id alone; the text is scanned once.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / n for i in range(1, n)]
    bounds = sorted(set(docs.approxQuantile("doc_id", shares, 0.25 / n))) if shares else []
    below = F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda x: x < F.col("doc_id"))
    ordered = (
        docs.select("doc_id", "text")
        .repartitionById(n, F.size(below))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    map_partitions(ordered, write, FILES).write.parquet(path)


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files, decoded: doc_id, start (tokens of all documents before it),
    n_tokens, ids_crc32, and ids if wanted."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n_part"))
    # One row per written partition, and below one per shard of a partition.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n_part").over(earlier), F.lit(0)).alias("_part"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select(
        "part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_shard")
    )
    starts = shards.join(parts, "part").select(
        "part", "shard", (F.col("_part") + F.col("_shard")).alias("_start")
    )
    kinds = "part int, shard int, doc_id bigint, _within bigint, n_tokens bigint, ids_crc32 bigint"
    if with_ids:
        kinds += ", ids array<int>"

    def read(batch: pa.RecordBatch):
        for row in range(batch.num_rows):
            file = TokenFile(batch.column("file")[row].as_py())
            ends = np.cumsum(file.lengths)
            data = memoryview(file.tokens().astype("<u4", copy=False)).cast("B")
            spans = list(zip((ends - file.lengths).tolist(), ends.tolist(), strict=True))
            found = {
                "part": np.repeat(batch.column("part")[row].as_py(), len(ends)),
                "shard": np.repeat(batch.column("shard")[row].as_py(), len(ends)),
                "doc_id": batch.column("doc_ids")[row].as_py(),
                "_within": ends - file.lengths,
                "n_tokens": file.lengths,
                "ids_crc32": [zlib.crc32(data[4 * a : 4 * b]) for a, b in spans],
            }
            if with_ids:
                found["ids"] = [np.frombuffer(data[4 * a : 4 * b], "<i4") for a, b in spans]
            yield found

    docs = map_batches(files.select("part", "shard", "doc_ids", "file"), read, kinds)
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id",
        (F.col("_start") + F.col("_within")).alias("start"),
        *[c for c in docs.columns if c not in ("part", "shard", "doc_id", "_within")],
    )
