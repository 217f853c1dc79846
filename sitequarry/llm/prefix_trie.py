"""The prefix trie of conversations: shared openings, their members, leaves and the tokens a cache saves.

A node is a distinct sequence of first turns (role, text); the root is the empty one.  Every conversation is a
member of the nodes along its path.  Keys of nodes are a hash chain over the turns, computed while each
conversation streams through a task in turn order, so equal openings meet in one aggregate anywhere.

Sums over subtrees come from shards of conversations.  Each shard builds the trie of its own conversations
as balanced parentheses (a node opens, its children follow, it closes), with a range min-max tree over blocks
of the excess: ``findclose`` of a node's open delimits its subtree, a rank over marked leaf pairs ``()`` counts
its leaves, and cumulative arrays of the nodes' values give its savings.  A node lies in every shard that
holds one of its members: the spines near the root are shared.  Each node's own value counts in one shard
only, the one of its smallest member; the shards' sums of a shared node are then added up by key.  Shards
are cut by conversation, so a very common opening is spread over all of them.

Defined cases: rows with a null conv_id belong to no conversation; null role or text is ""; turns are
ordered by turn (nulls first), then role and text, so ties and repeated rows have one order; a conversation
without turns is a member of the root only; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.llm.batches import map_partitions
from sitequarry.operators.lineage import Workspace

ROOT = b"\x00" * 16
#: Member rows a shard holds at most, on average; a shard is built in one task's memory.
ROWS_PER_SHARD = 1_000_000
#: Positions of balanced parentheses per block of the range min-max tree.
BLOCK = 64


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text): each conversation's turns numbered from 0."""
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")
    )
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return turns.select("conv_id", (F.row_number().over(order) - 1).alias("pos"), "role", "text")


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of every conv_id c after rebuilding: the first h turns of conversation c - c % 5, then c's own
    turns from its h-th on, h = crc32(decimal c) % 9.  Returns (turns as conv_id, pos, role, text;
    conv_id, n_turns of every conversation)."""
    turns = ordered_turns(conversations)
    convs = turns.select("conv_id").distinct().select(
        "conv_id",
        (F.crc32(F.col("conv_id").cast("string")) % 9).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
    )
    opening = turns.filter(F.col("pos") < 8).alias("t").join(
        convs.alias("c"), (F.col("t.conv_id") == F.col("c.base")) & (F.col("t.pos") < F.col("c.h"))
    )
    opening = opening.select(F.col("c.conv_id").alias("conv_id"), "t.pos", "t.role", "t.text")
    lengths = opening.groupBy("conv_id").agg(F.count("*").alias("head"))
    own = turns.alias("t").join(convs.alias("c"), "conv_id").filter(F.col("t.pos") >= F.col("c.h"))
    own = own.join(lengths, "conv_id", "left").select(
        "conv_id",
        (F.coalesce("head", F.lit(0)) + F.col("t.pos") - F.col("c.h")).alias("pos"),
        "t.role",
        "t.text",
    )
    rebuilt = opening.unionByName(own)
    counts = convs.join(rebuilt.groupBy("conv_id").agg(F.count("*").alias("n_turns")), "conv_id", "left")
    return rebuilt, counts.select("conv_id", F.coalesce("n_turns", F.lit(0)).alias("n_turns"))


def _chain(batches):
    """Member rows (conv_id, depth, key, parent, n_bytes) from turns sorted by conversation and position."""
    conv, key = None, ROOT
    for batch in batches:
        ids, roles, texts = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
        keys, parents, sizes, depths = [], [], [], []
        for c, role, text in zip(ids, roles, texts, strict=True):
            if c != conv:
                conv, key, depth = c, ROOT, 0
            role_bytes, text_bytes = role.encode(), text.encode()
            digest = hashlib.sha256(key)
            digest.update(len(role_bytes).to_bytes(8, "little"))
            digest.update(role_bytes)
            digest.update(text_bytes)
            depth += 1
            parents.append(key)
            key = digest.digest()[:16]
            keys.append(key)
            sizes.append(len(text_bytes))
            depths.append(depth)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                pa.array(depths, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array(parents, pa.binary()),
                pa.array(sizes, pa.int64()),
            ],
            names=["conv_id", "depth", "key", "parent", "n_bytes"],
        )


def member_rows(rebuilt: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per conversation and depth, root included: conv_id, depth, key, parent, n_bytes, ends."""
    sorted_turns = rebuilt.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    schema = "conv_id long, depth long, key binary, parent binary, n_bytes long"
    chained = map_partitions(sorted_turns.select("conv_id", "role", "text"), _chain, schema)
    root = counts.select(
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(ROOT).alias("key"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).cast("long").alias("n_bytes"),
    )
    members = chained.unionByName(root).join(counts, "conv_id")
    return members.withColumn("ends", F.col("depth") == F.col("n_turns")).drop("n_turns")


def node_table(members: DataFrame) -> DataFrame:
    """One row per node: key, parent, depth, n_bytes of its last text, conv_id, n_convs, ends_sha256."""
    ends = F.array_sort(F.collect_list(F.when(F.col("ends"), F.col("conv_id"))))
    return members.groupBy("key").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.first("n_bytes").alias("n_bytes"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.sha2(F.array_join(ends.cast("array<string>"), ","), 256).alias("ends_sha256"),
    )


class RangeMinMax:
    """Balanced parentheses with the minimum excess of each block and a tree over the blocks' minima."""

    def __init__(self, opens: np.ndarray):
        self.excess = np.cumsum(np.where(opens, 1, -1)).astype(np.int64)
        n = len(self.excess)
        blocks = max(1, math.ceil(n / BLOCK))
        padded = np.full(blocks * BLOCK, np.iinfo(np.int64).max)
        padded[:n] = self.excess
        self.size = 1 << max(0, (blocks - 1).bit_length())
        self.tree = np.full(2 * self.size, np.iinfo(np.int64).max)
        self.tree[self.size : self.size + blocks] = padded.reshape(blocks, BLOCK).min(axis=1)
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def findclose(self, i: int) -> int:
        """The close matching the open at ``i``: the first position after it whose excess is one less."""
        target = self.excess[i] - 1
        end = (i // BLOCK + 1) * BLOCK
        inside = np.flatnonzero(self.excess[i + 1 : end] <= target)
        if len(inside):
            return i + 1 + int(inside[0])
        k = self.size + i // BLOCK
        while True:  # up until a right sibling holds a low enough minimum
            if k & 1 == 0 and self.tree[k + 1] <= target:
                k += 1
                break
            k >>= 1
            if k == 0:
                raise ValueError("unbalanced parentheses")
        while k < self.size:  # down to the leftmost such block
            k = 2 * k if self.tree[2 * k] <= target else 2 * k + 1
        start = (k - self.size) * BLOCK
        inside = np.flatnonzero(self.excess[start : start + BLOCK] <= target)
        return start + int(inside[0])


def shard_sums(keys, parents, depths, values, leaves) -> tuple[list, np.ndarray, np.ndarray]:
    """Leaves and savings below every node of one shard's trie, counting only values given to this shard.

    ``values`` and ``leaves`` hold a node's own saving and whether it is a leaf of the whole trie, where the
    shard owns the node, else 0 and False."""
    index = {k: n for n, k in enumerate(keys)}
    children: list[list[int]] = [[] for _ in keys]
    roots = []
    for n, (p, d) in enumerate(zip(parents, depths, strict=True)):
        if d == 0:
            roots.append(n)
        else:
            children[index[p]].append(n)
    opens, order, open_at = [], [], np.zeros(len(keys), np.int64)
    stack = [(r, False) for r in reversed(roots)]
    while stack:
        node, done = stack.pop()
        if done:
            opens.append(False)
            continue
        open_at[node] = len(opens)
        opens.append(True)
        order.append(node)
        stack.append((node, True))
        stack.extend((c, False) for c in sorted(children[node], key=lambda c: keys[c], reverse=True))
    bp = np.array(opens, bool)
    tree = RangeMinMax(bp)
    at_open = np.zeros(len(bp), np.int64)
    at_open[open_at] = np.asarray(values, np.int64)
    saved = np.concatenate([[0], np.cumsum(at_open)])
    pairs = np.zeros(len(bp), np.int64)  # a leaf pair "()" counted where the whole trie has a leaf
    pairs[open_at] = np.asarray(leaves, bool) & ~bp[np.minimum(open_at + 1, len(bp) - 1)]
    ranks = np.concatenate([[0], np.cumsum(pairs)])
    close = np.array([tree.findclose(int(open_at[n])) for n in range(len(keys))], np.int64)
    return keys, ranks[close + 1] - ranks[open_at], saved[close + 1] - saved[open_at]


def _shards(batches):
    """Rows sorted by shard: for each shard, its trie's sums per node."""
    rows: dict[str, list] = {}
    current = None

    def flush():
        if not rows or not rows["key"]:
            return None
        owned = {
            (c, d): (v, leaf)
            for c, d, v, leaf, kind in zip(
                rows["conv_id"], rows["depth"], rows["value"], rows["leaf"], rows["owner"], strict=True
            )
            if kind
        }
        nodes: dict[bytes, list] = {}
        for c, d, k, p, kind in zip(
            rows["conv_id"], rows["depth"], rows["key"], rows["parent"], rows["owner"], strict=True
        ):
            if kind:
                continue
            node = nodes.setdefault(k, [p, d, 0, False])
            if (c, d) in owned:
                node[2], node[3] = owned[(c, d)]
        keys = list(nodes)
        found = shard_sums(
            keys,
            [nodes[k][0] for k in keys],
            [nodes[k][1] for k in keys],
            [nodes[k][2] for k in keys],
            [nodes[k][3] for k in keys],
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())],
            names=["key", "n_leaves", "saved_tokens"],
        )

    names = ["shard", "conv_id", "depth", "key", "parent", "value", "leaf", "owner"]
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in names}
        start = 0
        shards = columns["shard"]
        for i in range(len(shards) + 1):
            if i == len(shards) or shards[i] != current:
                for n in names:
                    rows.setdefault(n, []).extend(columns[n][start:i])
                start = i
                if i == len(shards):
                    break
                out = flush()
                if out is not None:
                    yield out
                rows, current = {}, shards[i]
    out = flush()
    if out is not None:
        yield out


def conversation_trie(conversations: DataFrame, workspace: Workspace) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the node's key."""
    spark = conversations.sparkSession
    rebuilt, counts = rebuilt_conversations(conversations)
    members = workspace.table(member_rows(rebuilt, counts), "trie-members")
    nodes = workspace.table(node_table(members), "trie-nodes")
    children = nodes.filter(F.col("parent").isNotNull()).groupBy("parent").agg(
        F.count("*").alias("n_children")
    )
    nodes = nodes.join(children.withColumnRenamed("parent", "key"), "key", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))
    )
    nodes = workspace.table(nodes, "trie-children")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, "parent", "left")

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(partitions, math.ceil(members.count() / ROWS_PER_SHARD))
    shard = F.pmod(F.xxhash64("conv_id"), F.lit(n_shards)).alias("shard")
    owners = nodes.select(
        "conv_id",
        "depth",
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("value"),
        (F.col("n_children") == 0).alias("leaf"),
    )
    routed = members.select(
        shard,
        "conv_id",
        "depth",
        "key",
        "parent",
        F.lit(0).cast("long").alias("value"),
        F.lit(False).alias("leaf"),
        F.lit(False).alias("owner"),
    ).unionByName(
        owners.select(
            shard,
            "conv_id",
            "depth",
            F.lit(None).cast("binary").alias("key"),
            F.lit(None).cast("binary").alias("parent"),
            "value",
            "leaf",
            F.lit(True).alias("owner"),
        )
    )
    routed = routed.repartition(n_shards, "shard").sortWithinPartitions("shard", "owner")
    sums = map_partitions(routed, _shards, "key binary, n_leaves long, saved_tokens long")
    sums = sums.groupBy("key").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")
    )
    return nodes.join(sums, "key", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        "ends_sha256",
        "key",
    )
