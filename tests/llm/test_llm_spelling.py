import re
import zlib
from collections import Counter

import duckdb
import pytest

from sitequarry.llm.spelling import Acceptor, one_edit_pairs, spelling_forms
from tests.llm.conftest import documents


def runs(doc_id, text):
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        if doc_id is not None:
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
        yield run


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long_ = sorted((a, b), key=len)
    return any(long_[:i] + long_[i + 1 :] == short for i in range(len(long_)))


def brute_forms(rows, factor=10):
    counts = Counter(w for doc_id, text in rows for w in runs(doc_id, text))
    vocab = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    words = sorted(vocab)
    letters = sorted({c for w in words for c in w})
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    result = {}
    for w in words:
        if len(w) > 100:  # few words this long: compare them pairwise
            partners = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_length.get(k, []) if near(w, v)]
            best = min(partners, key=lambda v: (-vocab[v], v)) if partners else None
            form = best if best is not None and vocab[best] >= factor * vocab[w] else None
            result[w] = [form, vocab[w], len(partners), vocab[form] if form else None]
            continue
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        edits |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        partners = sorted(v for v in edits - {w} if v in vocab)
        best = min(partners, key=lambda v: (-vocab[v], v)) if partners else None
        form = best if best is not None and vocab[best] >= factor * vocab[w] else None
        result[w] = [form, vocab[w], len(partners), vocab[form] if form else None]
    for w in words:
        root = w
        while result[root][0] is not None:
            root = result[root][0]
        result[w].append(root)
    return sorted((w, f, r, n, k, fn) for w, (f, n, k, fn, r) in result.items())


def spark_forms(spark, rows, workspace):
    got = spelling_forms(documents(spark, rows), workspace).collect()
    return sorted(tuple(r) for r in got)


def test_acceptor_is_minimal_and_exact():
    words = sorted({"walking", "talking", "walked", "talked", "stalking", "stalked"})
    machine = Acceptor(words)
    assert sorted(machine.suffixes(0)) == words
    reached, stack = {0}, [0]
    while stack:
        for nxt in machine.edges[stack.pop()].values():
            if nxt not in reached:
                reached.add(nxt)
                stack.append(nxt)
    # w-, t- and st- share "alk", "-ing" and "-ed" end alike: 10 states, where a trie has 30.
    assert len(reached) == 10


def test_pairs_equal_brute_force():
    words = ["spelling", "speling", "spelliing", "spellinh", "pelling", "spellin", "xspelling", "other"]
    expected = {(a, b) for a in words for b in words if near(a, b)}
    assert one_edit_pairs(words) == expected


def test_pairs_of_long_and_repeated_letters():
    words = ["a" * 3000, "a" * 2999, "a" * 3001, "a" * 1500 + "b" + "a" * 1499, "aaaaaaa", "aaaaaaaa"]
    expected = {(a, b) for a in words for b in words if near(a, b)}
    assert one_edit_pairs(words) == expected


def test_forms_equal_brute_force_on_documents(spark, workspace):
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assert spark_forms(spark, rows, workspace) == brute_forms(rows)


def test_odd_rows(spark, workspace):
    rows = [
        (1, "Receive receive recieve " * 12),
        (2, "receive " * 30 + "RECEIVE recieve"),
        (3, None),
        (4, ""),
        (None, "recieve recieve recievve"),
        (5, "Ünïcödé ünicode unicodé " * 3),
        (6, "x" * 30000 + " " + "x" * 29999 + " " + "x" * 30000),
        (7, "abcdefgh abcdefgh abcdefg abcdefg abcdefgi abcdefgi " * 11),
        (7, "abcdefgh abcdefgh"),
    ]
    assert spark_forms(spark, rows, workspace) == brute_forms(rows)


def test_empty_and_clashing(spark, workspace):
    docs = documents(spark, [(1, "x")]).limit(0)
    assert spelling_forms(docs, workspace).count() == 0
    rows = [(i, "colour color colours " * 4 + "colors") for i in range(3)]
    df = documents(spark, rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")
    got = sorted(tuple(r) for r in spelling_forms(df, workspace).collect())
    assert got == brute_forms(rows)
