"""Deduplication and decontamination against SQL and brute force, with the odd inputs each must take."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from comparing import connect, difference
from llm.conftest import documents
from sitequarry.llm import near_dedup, substring_dedup
from sitequarry.llm.components import components
from sitequarry.llm.decontaminate import find_contamination
from sitequarry.llm.fm_index import FMIndex
from sitequarry.llm.line_dedup import dedup_lines
from sitequarry.llm.near_dedup import drop_near_duplicates, near_duplicate_classes
from sitequarry.llm.queries import ORACLES, QUERIES
from sitequarry.llm.seen_twice import SeenTwice, log_bits, seen_twice
from sitequarry.llm.substring_dedup import leftmost_minima, remove_repeats, repeated_spans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def words_of(n, seed, vocabulary=5000):
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


# Two filters


def test_filter_of_keys_seen_twice_loses_none(spark):
    keys = [*range(4000), *range(1000), 7]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)

    def hashes_of(batch):
        yield np.array([k * 2654435761 % 2**61 for k in batch.column(0).to_pylist()], np.uint64)

    size = log_bits(len(keys))
    known = SeenTwice(seen_twice(rows, hashes_of, size), size)
    hashed = np.array([k * 2654435761 % 2**61 for k in range(4000)], np.uint64)
    suspects = known.suspects(hashed)
    assert suspects[:1000].all()
    assert suspects[1000:].mean() < 0.02
    assert int(hashed[3]) in known


# Lines


def brute_lines(rows, min_chars=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    last = 2**63 - 1
    first, holders = {}, defaultdict(set)
    for doc_id, text in rows:
        doc = last if doc_id is None else doc_id
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                first[key(line)] = min(doc, first.get(key(line), doc))
                holders[key(line)].add(doc)
    for doc_id, text in rows:
        doc = last if doc_id is None else doc_id
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or first[key(x)] == doc]
        yield doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)


def test_lines_of_odd_texts(spark, workspace):
    same = "A line that is long enough"
    rows = [
        (5, f"{same}\nown five\n\n"),
        (2, f"  {same.upper()}\t\nown text of two\n{same}"),
        (9, f"{same}\n{same}"),
        (9, f"{same}\n{same}"),
        (None, f"{same}\nshort"),
        (7, None),
        (8, ""),
        (10, "\n\n\n"),
        (11, "ÀÉ line É with accents"),
        (12, "àé line é with accents\nÀÉ LINE É WITH ACCENTS"),
        (13, "x" * 200_000 + "\n" + "y" * 9),
        (14, "x" * 200_000 + "\n" + "y" * 9 + "\r"),
    ]
    docs = documents(spark, rows).withColumn("n_lines", F.lit("clash"))
    got = dedup_lines(docs, workspace)
    assert got.columns.count("n_lines") == 1 and "source" in got.columns
    found = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute_lines(rows), key=repr)
    assert dedup_lines(docs.limit(0), workspace).collect() == []


def test_lines_keep_columns_named_like_helpers(spark, workspace):
    same = "A line that is long enough"
    rows = [(1, f"{same}\nown one"), (2, f"{same}\nown two"), (3, None)]
    names = ["doc", "version", "drop", "_drop", "line", "key", "salt", "first", "low", "high"]
    docs = documents(spark, rows)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string"), F.lit(k)))
    got = dedup_lines(docs, workspace)
    assert got.columns == docs.columns + ["n_lines", "n_dropped"]
    for row in got.collect():
        for k, name in enumerate(names):
            assert row[name] == f"{name}-{row['doc_id']}{k}"
    found = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute_lines(rows), key=repr)


def test_line_in_every_document(spark, workspace):
    rows = [(i, f"the very common line\nown line number {i}") for i in range(3000)]
    got = dedup_lines(documents(spark, rows).repartition(7), workspace)
    assert got.groupBy("n_dropped").count().orderBy("n_dropped").collect() == [(0, 1), (1, 2999)]


# Substrings


def brute_substrings(rows, size):
    split = [(text or "").encode().split() for _, text in rows]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        yield doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()


def compare_substrings(spark, workspace, rows, size=12):
    got = remove_repeats(documents(spark, rows).repartition(5), workspace, size)
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute_substrings(rows, size), key=repr)
    return found


def test_substrings_of_odd_texts(spark, workspace):
    base, other = words_of(300, 1), words_of(80, 2)
    edited = [*base[:100], "changed", *base[101:]]
    rows = [
        (1, " ".join(base)),
        (2, "\n".join(edited)),
        (3, " ".join([*other, *base[20:31], *other[:40]])),
        (4, " ".join([*base[200:212], "x"])),
        (5, " ".join(["the", "same"] * 60)),
        (6, "a b " * 30),
        (None, " ".join(other[:11])),
        (7, None),
        (8, ""),
        (9, " ".join(words_of(12, 3))),
        (10, " ".join(words_of(12, 3))),
        (11, " ".join(words_of(12, 4))),
    ]
    compare_substrings(spark, workspace, rows)
    compare_substrings(spark, workspace, [*rows, (12, " ".join(words_of(40, 9))), (12, " ".join(words_of(40, 9)))])
    clash = documents(spark, rows).withColumn("n_words", F.lit("x")).withColumn("version", F.lit(3))
    clash = clash.withColumn("doc", F.lit("d")).withColumn("_doc", F.lit("e")).withColumn("removed", F.lit(1))
    got = remove_repeats(clash, workspace, 12)
    assert {"n_words", "n_removed", "lang"} <= set(got.columns)
    kept = got.select("version", "doc", "_doc").distinct().collect()
    assert [tuple(r) for r in kept] == [(3, "d", "e")]
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(brute_substrings(rows, 12), key=repr)
    assert remove_repeats(documents(spark, []), workspace, 12).collect() == []


def test_substrings_of_hot_anchors_are_counted_by_window(spark, workspace, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_SEGMENTS", 20)
    passage = words_of(20, 5)
    rows = [(i, " ".join([*words_of(30, 100 + i), *passage, *words_of(30, 900 + i)])) for i in range(80)]
    rows += [(200 + i, rows[i][1]) for i in range(3)]
    found = compare_substrings(spark, workspace, rows)
    assert all(removed >= 20 for _, _, removed, _ in found)


def test_substrings_over_many_small_shards(spark, workspace, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50)
    base = words_of(120, 6, 40)
    rows = [(i, " ".join(base[i * 3 :] + words_of(10, i) + base[: i * 3])) for i in range(30)]
    compare_substrings(spark, workspace, rows)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_spans_against_counting(seed):
    rng = np.random.default_rng(seed)
    size = 6
    texts = list({tuple(rng.integers(0, 3, rng.integers(size, 30))) for _ in range(40)})
    counts = rng.integers(1, 3, len(texts))
    found = repeated_spans([np.array(t, np.uint64) for t in texts], counts, size)
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    for text, n, spans in zip(texts, counts, found, strict=True):
        gone = set(range(len(text))) if n > 1 else set()
        for i in range(len(text) - size + 1):
            if seen[text[i : i + size]] > 1:
                gone.update(range(i, i + size))
        got = {p for a, b in zip(spans[::2], spans[1::2], strict=True) for p in range(a, b)}
        assert got == gone


def test_fm_index_counts_and_matching_statistics():
    rng = np.random.default_rng(0)
    ids = np.append(rng.integers(1, 4, 300), 0)
    index = FMIndex(ids, 40)
    text = ids.tolist()
    for size in (1, 3, 6):
        for at in range(0, 200, 17):
            pattern = ids[at : at + size]
            expected = sum(text[i : i + size] == pattern.tolist() for i in range(301 - size))
            assert index.count(pattern) == expected
    assert index.count(np.array([9])) == 0
    ends = np.arange(40, 300)
    for end, n in zip(ends, index.matching_statistics(ids, ends, np.full(len(ends), 12)), strict=True):
        occurs = lambda k: sum(text[i : i + k] == text[end + 1 - k : end + 1] for i in range(301 - k))  # noqa: B023, E731
        assert n == max(k for k in range(13) if not k or occurs(k) > 1)


def test_leftmost_minima():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 7, 28):
        got = leftmost_minima(values, width).tolist()
        assert got == [i + int(np.argmin(values[i : i + width])) for i in range(201 - width)]


# Near-duplicates


def brute_shingles(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))


def brute_classes(rows, threshold=near_dedup.THRESHOLD):
    """Components of all pairs, and how far the nearest pair is from the threshold."""
    texts = sorted({t or "" for _, t in rows})
    sets = [brute_shingles(t) for t in texts]
    n = len(rows)
    frequency = Counter()
    for _, t in rows:
        frequency.update(set(brute_shingles(t)))
    weigh = lambda s, tf: (1 + np.log(tf)) * (1 + near_dedup.IDF_SHARE * np.log(n / frequency[s]) / np.log(n))
    weights = [{s: weigh(s, tf) for s, tf in c.items()} for c in sets]
    holders = defaultdict(list)
    for i, c in enumerate(sets):
        for s in c:
            holders[s].append(i)
    near = {p for h in holders.values() for p in combinations(h, 2)}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    margin = 1.0
    for a, b in near:
        common = sum(min(weights[a][s], weights[b][s]) for s in weights[a].keys() & weights[b].keys())
        similarity = common / (sum(weights[a].values()) + sum(weights[b].values()) - common)
        margin = min(margin, abs(similarity - threshold))
        if similarity >= threshold:
            root[find(a)] = find(b)
    place = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for doc_id, t in rows:
        if doc_id is not None:
            least[place[t or ""]] = min(doc_id, least.get(place[t or ""], doc_id))
    return {(doc_id, t): least.get(place[t or ""]) for doc_id, t in rows}, margin


def test_op7_classes_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    expected, _ = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in QUERIES["op7_near_dedup"](spark, SF).collect()}
    assert got == {doc_id: c for (doc_id, _), c in expected.items()}


def near_copies(n, seed, edits):
    """A text of 200 words and copies that differ in a few words each."""
    base, rng = words_of(200, seed), np.random.default_rng(seed)
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, 200, edits):
            copy[at] = f"e{rng.integers(0, 10**9)}"
        yield " ".join(copy)


def test_near_copies_of_odd_texts(spark, workspace):
    rows = [(i, t) for i, t in enumerate(near_copies(40, 1, 3))]
    rows += [(100 + i, t) for i, t in enumerate(near_copies(10, 2, 30))]
    rows += [(200, None), (201, ""), (202, "!!!"), (203, "one two"), (204, "One, two."), (205, "one two three")]
    rows += [(300 + i, rows[0][1]) for i in range(30)] + [(300, rows[0][1]), (None, rows[1][1]), (None, "lone text")]
    rows += [(400, "word " * 100_000), (401, "word " * 100_001)]
    expected, margin = brute_classes(rows)
    assert margin > 1e-4
    docs = documents(spark, rows).withColumn("node", F.lit("clash")).withColumn("class_id", F.lit("clash"))
    got = near_duplicate_classes(docs, workspace)
    assert got.count() == len(rows)
    digests = {r.node: t for (_, t) in rows for r in [type("R", (), {"node": hashlib.md5((t or "").encode()).digest()})]}
    for r in got.collect():
        texts = [t for d, t in rows if d == r.doc_id and (t or "") == (digests[bytes(r.node)] or "")]
        assert r.class_id == expected[r.doc_id, texts[0]]
    kept = drop_near_duplicates(docs, workspace)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert {i for i in ids if i is not None} == {c for c in expected.values() if c is not None}
    assert ids[None] == 1 and ids[0] == 1
    assert near_duplicate_classes(docs.limit(0), workspace).collect() == []


def test_chain_of_near_copies_is_one_class(spark, workspace):
    base = words_of(400, 3)
    rows = []
    for i in range(25):
        rows.append((i, " ".join([*[f"n{j}" for j in range(12 * i)], *base[12 * i :]])))
    expected, _ = brute_classes(rows)
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(documents(spark, rows), workspace).collect()}
    assert got == {d: c for (d, _), c in expected.items()}
    assert set(got.values()) == {0}


def test_long_open_pair_with_repeats_is_compared(spark, workspace, monkeypatch):
    """In one bucket whose pivot is like neither, a long text and the same text with passages said three times."""
    sign = near_dedup._sign
    one = F.array(F.lit(1).cast("long"))
    monkeypatch.setattr(near_dedup, "_sign", lambda *a: sign(*a).withColumn("buckets", one))
    words = [f"w{i}" for i in range(15_000)]
    rows = [(0, " ".join(words[:10_000])), (1, " ".join(words))]
    rows.append((2, " ".join(words + [f"p{i}" for i in range(1_580)] * 3)))
    expected, margin = brute_classes(rows)
    assert margin > 2e-3
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(documents(spark, rows), workspace).collect()}
    assert got == {d: c for (d, _), c in expected.items()} == {0: 0, 1: 1, 2: 1}


@pytest.mark.parametrize("n", [3, 200, 20_000])
def test_bound_is_never_below_what_two_texts_have_in_common(n):
    rng = np.random.default_rng(n)
    hashes = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    for share in (0.1, 0.7, 1.0):
        mine, own = (np.flatnonzero(rng.random(n) < share) for _ in range(2))
        mine, own = np.append(mine, n - 1), np.append(own, n - 1)
        wa, wb = (rng.integers(1, 11, len(x)).astype(np.float32) for x in (mine, own))
        bounds = np.array([0, len(mine), len(mine) + len(own)])
        total, unit, sums = near_dedup.cell_sums(
            hashes[np.concatenate([mine, own])], np.concatenate([wa, wb]), bounds
        )
        assert total.tolist() == [wa.sum(), wb.sum()]
        _, i, j = np.intersect1d(mine, own, return_indices=True)
        common = np.minimum(wa[i], wb[j]).sum()
        assert np.minimum(sums[0] * unit[0], sums[1] * unit[1]).sum() >= common * (1 - 1e-9)


def test_components_of_paths_stars_and_cycles(spark, workspace):
    rng = np.random.default_rng(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(200, 201), (201, 202), (202, 200)]
    links += [(300, 300)]
    names = rng.permutation(1000).tolist()
    rows = [(names[a], names[b]) for a, b in links]
    got = dict(components(spark.createDataFrame(rows, "u long, v long"), workspace).collect())
    groups = [range(61), range(100, 151), range(200, 203)]
    assert got == {names[i]: min(names[j] for j in g) for g in groups for i in g}


def test_sampler_agrees_as_often_as_the_sets_are_alike():
    rng = np.random.default_rng(5)
    hashes = np.sort(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    weights = (1 + rng.random(3000)).astype(np.float32)
    left, right = np.arange(0, 2700), np.arange(300, 3000)
    both = np.concatenate([left, right])
    similarity = weights[300:2700].sum() / weights.sum()
    a, b = near_dedup.Sampler(200, 1, 15).samples(hashes[both], weights[both], np.array([0, 2700, 5400]))
    assert abs((a == b).mean() - similarity) < 0.1


@pytest.mark.parametrize("n", [50_000, 200_000])
def test_band_sampler_agrees_on_large_sets_with_repeats(n):
    """One set is the other plus a few elements of weight 10; weights from 1 to 10 elsewhere."""
    rng = np.random.default_rng(n)
    hashes = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    more = rng.random(n) < 0.05
    one = np.where(more, np.float32(10), np.float32(1))
    many = np.where(more, 10, rng.integers(1, 11, n)).astype(np.float32)
    bands = [near_dedup.sampler(), *(near_dedup.Sampler(100, s, 23) for s in (1, 2, 3))]
    for weights in (one, many):
        similarity = weights[~more].sum(dtype=float) / weights.sum(dtype=float)
        both = np.concatenate([np.flatnonzero(~more), np.arange(n)])
        bounds = np.array([0, int((~more).sum()), len(both)])
        agree = []
        for sampler in bands:
            a, b = sampler.samples(hashes[both], weights[both], bounds)
            agree += (a == b).tolist()
        sd = np.sqrt(similarity * (1 - similarity) / len(agree))
        assert abs(np.mean(agree) - similarity) < 4 * sd


def test_shingles_are_bounded_by_rows():
    hashes, tf, bounds = near_dedup.shingles(pa.array(["a b c d e f", None, "a b", "a b c d e a b c d e"]))
    assert np.diff(bounds).tolist() == [2, 0, 1, 5]
    assert sorted(tf.tolist()) == [1] * 7 + [2]


# Contamination


def test_contamination_of_odd_texts(spark, workspace):
    long_item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda"
    items = [(1, long_item), (2, "Short ITEM"), (2, "short item"), (3, None), (4, "..."), (None, "no name here"), (10, "é1 ü2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "x ALPHA beta gamma-delta epsilon zeta eta theta iota kappa y lambda"),
        (2, "a short item; short  item short"),
        (3, "alpha beta gamma delta epsilon"),
        (4, None),
        (5, ""),
        (6, "No name here, É1 Ü2 é1 ü2"),
        (6, "No name here, É1 Ü2 é1 ü2"),
        (None, "shortitem short items"),
        (7, "pad " * 100_000 + "short item"),
    ]
    docs = documents(spark, rows).withColumn("items", F.lit("clash"))
    for block_bytes in (1 << 20, 30):
        got = find_contamination(docs, benchmark, workspace, block_bytes=block_bytes)
        found = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()]
        assert sorted(found, key=repr) == sorted(
            [
                (1, 13, 10, ["1"], True),
                (2, 6, 4, ["2"], True),
                (3, 5, 0, [], False),
                (4, 0, 0, [], False),
                (5, 0, 0, [], False),
                (6, 7, 5, ["10"], True),
                (6, 7, 5, ["10"], True),
                (None, 3, 0, [], False),
                (7, 100_002, 2, ["2"], True),
            ],
            key=repr,
        )
    cut = {r.doc_id: r.text for r in find_contamination(docs, benchmark, workspace, remove="spans").collect()}
    assert cut[1] == "x  y lambda" and cut[2] == "a  short" and cut[3] == rows[2][1] and cut[4] is None
    left = find_contamination(docs, benchmark, workspace, remove="documents")
    assert sorted((r.doc_id for r in left.collect()), key=str) == [3, 4, 5, None]
    nothing = find_contamination(docs, benchmark.limit(0), workspace)
    assert nothing.filter("contaminated").count() == 0
    assert find_contamination(docs.limit(0), benchmark, workspace).collect() == []
