import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from sitequarry.llm.prefix_trie import RangeMinMax, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    """The contract, conversation by conversation."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn if turn is not None else 0, role or "", text or ""))
    for c in turns:
        turns[c] = [(r, t) for _, _, r, t in sorted(turns[c])]
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        rebuilt[c] = turns.get(base, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    nodes = {}
    for path, convs in members.items():
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(path))
        nodes[path] = {
            "conv_id": min(convs),
            "depth": len(path),
            "n_convs": len(convs),
            "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        }
    for path, node in nodes.items():
        node["parent_conv_id"] = nodes[path[:-1]]["conv_id"] if path else None
        kids = [p for p in nodes if len(p) == len(path) + 1 and p[: len(path)] == path]
        node["n_children"] = len(kids)
    for path, node in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        node["n_leaves"] = sum(1 for p in below if nodes[p]["n_children"] == 0)
        node["saved_tokens"] = sum(
            (nodes[p]["n_convs"] - 1) * (len(p[-1][1].encode()) if p else 0) for p in below
        )
    return sorted(tuple(sorted(n.items())) for n in nodes.values())


def spark_trie(spark, df, workspace):
    got = conversation_trie(df, workspace).drop("key").collect()
    return sorted(tuple(sorted(r.asDict().items())) for r in got)


def test_findclose_matches_a_stack():
    rng = np.random.default_rng(3)
    for n in (1, 5, 200, 3000):
        bits = []
        depth = 0
        for _ in range(n):
            if depth and rng.random() < 0.5:
                bits.append(False)
                depth -= 1
            else:
                bits.append(True)
                depth += 1
        bits += [False] * depth
        tree, stack = RangeMinMax(np.array(bits)), []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                assert tree.findclose(stack.pop()) == i


def test_trie_equals_brute_force_on_conversations(spark, workspace):
    rows = duckdb.sql(
        "SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet'"
    ).fetchall()
    assert spark_trie(spark, spark.createDataFrame(rows, SCHEMA), workspace) == brute_trie(rows)


def test_odd_rows(spark, workspace):
    rows = [
        (0, 0, "user", "hello"),
        (0, 1, "assistant", "hi"),
        (0, None, "system", None),
        (1, 0, "user", "hello"),
        (1, 0, "user", "hello"),
        (2, 5, None, "x" * 100000),
        (3, 1, "user", "b"),
        (3, 1, "user", "a"),
        (None, 0, "user", "lost"),
        (5, 0, "user", ""),
        (7, 2, "user", "hello"),
        (-3, 0, "user", "negative"),
        (12, 0, "user", "héllo 😀"),
        (14, 0, "user", "héllo 😀"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert spark_trie(spark, df, workspace) == brute_trie(rows)


def test_copies_and_clashing_columns(spark, workspace):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for c in range(60) for t in range(4)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("k"))
    df = df.withColumn("shard", df["turn"]).withColumn("depth", df["turn"])
    assert spark_trie(spark, df, workspace) == brute_trie(rows)


def test_empty_table(spark, workspace):
    assert conversation_trie(spark.createDataFrame([], SCHEMA), workspace).count() == 0


@pytest.mark.parametrize("shards", [1, 7])
def test_shard_count_does_not_matter(spark, workspace, monkeypatch, shards):
    import sitequarry.llm.prefix_trie as trie

    rows = duckdb.sql(
        "SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.001/conversations.parquet'"
    ).fetchall()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        assert spark_trie(spark, spark.createDataFrame(rows, SCHEMA), workspace) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
