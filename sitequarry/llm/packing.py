"""Packing of documents into token sequences: shortest pack first over the histogram of lengths.

A document longer than a sequence is cut into full sequences and a rest.  The histogram of lengths (at most
``capacity`` rows) goes to the driver.  Lengths are placed longest first: each goes to the open pack with the
most room, and what fits nowhere opens new packs.  Packs that hold the same lengths are one pattern with a
count, so the work depends on the number of lengths, not of documents.  Pieces find their pack by their
rank among the pieces of the same length, which is computed over salted groups.

Defined cases: a null or empty text is a document of one token, the end token; repeated rows are packed as
often as they occur; a column of ``docs`` with the name of a result is replaced.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.batches import fresh_name, map_batches, slices
from sitequarry.llm.bpe import encoder
from sitequarry.llm.token_counts import read_spec
from sitequarry.operators.lineage import Workspace

CAPACITY = 2048
END_ID = 1

def cut_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """The tokens of each document, ended by ``end_id``, in pieces of at most ``capacity``: the columns of
    ``docs`` without text, then start, length, ids_crc32, doc_tokens, and ids if wanted."""
    added = {n: "bigint" for n in ("start", "length", "ids_crc32", "doc_tokens")}
    if with_ids:
        added["ids"] = "array<int>"
    kept = [f for f in docs.schema.fields if f.name not in (*added, "text", "ids")]
    docs = docs.select(*[f.name for f in kept], "text")
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batch: pa.RecordBatch):
        encode = encoder(spec.value).encode
        for part in slices(batch):
            rows, starts, pieces, totals = [], [], [], []
            for row, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                ids += end
                for start in range(0, len(ids), 4 * capacity):
                    rows.append(row)
                    starts.append(start // 4)
                    pieces.append(ids[start : start + 4 * capacity])
                    totals.append(len(ids) // 4)
            at = pa.array(rows)
            found = {
                "start": starts,
                "length": [len(p) // 4 for p in pieces],
                "ids_crc32": [zlib.crc32(p) for p in pieces],
                "doc_tokens": totals,
            }
            if with_ids:
                found["ids"] = [np.frombuffer(p, "<u4").astype(np.int32) for p in pieces]
            yield {f.name: part.column(f.name).take(at) for f in kept} | found

    kinds = {f.name: f.dataType.simpleString() for f in kept} | added
    return map_batches(docs, cut, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(count, pattern) of packs for the given numbers of pieces by length; a pattern is runs of
    (length, how many), longest first."""
    open_packs: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)
    rooms: list[int] = []
    full: list[tuple[int, Pattern]] = []

    def put(count: int, pattern: Pattern, room: int) -> None:
        if not room:
            full.append((count, pattern))
        else:
            if not open_packs[room]:
                heappush(rooms, -room)
            open_packs[room].append((count, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                count, pattern = open_packs[room].pop()
                if not open_packs[room]:
                    heappop(rooms)
                used = min(count, left)
                if used < count:
                    put(count - used, pattern, room)
                put(used, _longer(pattern, length), room - length)
                left -= used
            else:
                # The pieces that follow go to the pack just opened for as long as it has the most room.
                each = capacity // length
                if left >= each:
                    put(left // each, ((length, each),), capacity - each * length)
                if left % each:
                    put(1, ((length, left % each),), capacity - left % each * length)
                left = 0
    return full + [pack for packs in open_packs.values() for pack in packs]


def _longer(pattern: Pattern, length: int) -> Pattern:
    if pattern[-1][0] == length:
        return (*pattern[:-1], (length, pattern[-1][1] + 1))
    return (*pattern, (length, 1))


class Slots:
    """Which sequence and offset a piece gets by its length and its rank among the pieces of that length."""

    def __init__(self, packs: list[tuple[int, Pattern]]):
        slots, sequence = [], 0
        for count, pattern in sorted(packs, key=lambda p: p[1], reverse=True):
            offset = 0
            for length, many in pattern:
                for _ in range(many):
                    slots.append((length, count, sequence, offset))
                    offset += length
            sequence += count
        slots.sort(key=lambda s: s[0])
        first = []
        for _, group in groupby(slots, key=lambda s: s[0]):
            rank = 0
            for _, count, _, _ in group:
                first.append(rank)
                rank += count
        self.n_sequences = sequence
        self.first = np.array(first, np.int64)
        self.length, _, self.sequence, self.offset = np.array(slots, np.int64).reshape(-1, 4).T.copy()
        self.keys = self._key(self.length, self.first)

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length.astype(np.uint64) << np.uint64(44)) + rank.astype(np.uint64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, self._key(length, rank), side="right") - 1
        return self.sequence[at] + rank - self.first[at], self.offset[at]


def pack_pieces(
    pieces: DataFrame, workspace: Workspace, order: list[str], capacity: int = CAPACITY
) -> DataFrame:
    """``pieces`` (any columns, and ``length``) with sequence_id and offset.

    ``order`` names columns that tell the pieces of a length apart; pieces alike in all of them are
    interchangeable.
    """
    spark = workspace.spark
    salts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Helper columns get names that no column of the caller has.
    taken = set(pieces.columns) | {"sequence_id", "offset", "length", "n"}
    salt, rank, before = (fresh_name(n, taken) for n in ("_salt", "_rank", "_before"))
    salted = pieces.drop("sequence_id", "offset").withColumn(
        salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    )
    salted = workspace.table(salted, "pieces")
    # At most one row per length and salt, so a group of the window below has at most that many rows.
    groups = salted.groupBy("length", salt).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    groups = workspace.table(
        groups.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))), "groups"
    )
    histogram = dict(groups.groupBy("length").agg(F.sum("n")).collect())  # at most capacity rows
    slots = spark.sparkContext.broadcast(Slots(shortest_pack_first(histogram, capacity)))
    within = Window.partitionBy("length", salt).orderBy(*order)
    ranked = (
        salted.withColumn(rank, F.row_number().over(within) - 1)
        .join(groups.drop("n"), ["length", salt])
        .withColumn(rank, F.col(rank) + F.col(before))
        .select(*[c for c in salted.columns if c != salt], rank)
    )
    names = [c for c in ranked.columns if c != rank]

    def place(batch: pa.RecordBatch):
        length, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", rank))
        sequence, offset = slots.value.place(length, ranks)
        yield {n: batch.column(n) for n in names} | {"sequence_id": sequence, "offset": offset}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != rank)
    return map_batches(ranked, place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer: str, workspace: Workspace, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """One row per piece of a document: what ``cut_documents`` gives, with sequence_id and offset."""
    pieces = cut_documents(docs, tokenizer, capacity, with_ids=with_ids)
    return pack_pieces(pieces, workspace, ["doc_id", "start", "ids_crc32", "doc_tokens"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts) of packed pieces with ids; a group has at most a sequence's tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.flatten("_parts.ids").alias("ids"), F.col("_parts.offset").alias("starts")
    )
