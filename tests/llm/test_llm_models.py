"""Language, quality and fingerprints: held-out accuracy, plain-Python versions, and odd inputs."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import documents
from sitequarry.llm.fingerprint import compare_with_next, edited, fingerprint_documents, fingerprints, likeness
from sitequarry.llm.language_id import code_points, identify, ngrams, train, train_and_identify
from sitequarry.llm.quality import (
    FEATURES,
    AdditiveModel,
    add_features,
    text_features,
    train_and_score,
)
from sitequarry.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def whole(spark, sf_dir=SF):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


# Language


def test_op5_is_right_on_held_out_documents(spark):
    langs = {r.doc_id: r.lang for r in whole(spark)}
    got = QUERIES["op5_language_id"](spark, SF).collect()
    assert len(got) == len(langs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    right = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out]
    assert len(right) > 100 and np.mean(right) >= 0.97


def test_language_of_odd_texts(spark, workspace):
    rows = [(i, "the house and the garden " * 5) for i in range(40)]
    docs = documents(spark, rows).unionByName(
        documents(spark, [(100 + i, "das Haus und der Garten " * 5) for i in range(40)]).withColumn("lang", F.lit("de"))
    )
    odd = [(200, None), (201, ""), (202, "123 456 !!"), (203, "und der"), (204, "THE GARDEN"), (None, "the the"), (205, "家🙂")]
    odd = documents(spark, [*odd, (206, "the garden " * 100_000), (204, "THE GARDEN")]).withColumn("lang", F.lit(None).cast("string"))
    docs = docs.unionByName(odd).withColumn("score", F.lit("clash"))
    got = train_and_identify(docs, workspace)
    assert got.columns.count("score") == 1 and "source" in got.columns
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append(r)
    assert [found[i][0].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert [found[i][0].score for i in (200, 201, 202)] == [0.0] * 3
    assert [found[i][0].lang_pred for i in (203, 204, 206, None)] == ["de", "en", "en", "en"]
    assert len(found[204]) == 2 and found[None][0].held_out is False
    assert found[205][0].lang_pred in ("de", "en")
    blind = identify(docs.withColumn("lang", F.lit("fr")), train(docs.select("doc_id", "text", "lang"), workspace))
    assert {r.lang_pred for r in blind.filter("doc_id < 40").collect()} == {"en"}
    untaught = train_and_identify(odd, workspace).collect()
    assert {(r.lang_pred, r.score) for r in untaught} == {("und", 0.0)}
    assert train_and_identify(docs.limit(0), workspace).collect() == []


def test_language_sample_is_bounded_and_whole_counts_priors(spark, workspace):
    docs = documents(spark, [(i, "a b") for i in range(2000)])
    languages, matrix, priors = train(docs, workspace, per_language=100)
    assert languages == ["en"] and matrix.shape == (1 << 16, 1) and priors.tolist() == [0.0]


def test_ngrams_stay_within_rows():
    codes, bounds, lettered = code_points(pa.array(["ab", None, "ABc", "1"]))
    assert lettered.tolist() == [True, False, True, False]
    cells = dict(zip((1, 2, 3, 4), ngrams(codes, bounds), strict=False))
    assert np.diff(cells[2][1]).tolist() == [1, 0, 2, 0]
    assert np.diff(cells[3][1]).tolist() == [0, 0, 1, 0]
    assert cells[2][0][0] == cells[2][0][1]


# Quality


def area_under_curve(scores, labels):
    order = np.argsort(scores)
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    one = labels == 1
    return (rank[one].sum() - one.sum() * (one.sum() - 1) / 2) / (one.sum() * (~one).sum())


def test_op6_ranks_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op6_quality"](spark, SF).collect()
    assert len(got) == len(whole(spark))
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    scores, truth = np.array([r.score for r in held]), np.array([labels[r.doc_id] for r in held])
    assert area_under_curve(scores, truth) >= 0.95


def test_quality_of_odd_texts(spark, workspace):
    rows = [(i, "plain words in a plain line. " * (1 + i % 5)) for i in range(60)]
    rows += [(100 + i, "BUY!! NOW!! $$$ " * (1 + i % 5)) for i in range(60)]
    rows += [(200, None), (201, ""), (None, "plain words"), (202, "A" * 300_000), (0, rows[0][1])]
    labels = [(i, 1) for i in range(50)] + [(100 + i, 0) for i in range(50)] + [(55, None), (0, 1), (999, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = documents(spark, rows).withColumn("features", F.lit("clash"))
    got = train_and_score(docs.drop("features"), labels, workspace).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert min(by_id[i].score for i in range(50, 60)) > 0.7 > max(by_id[i].score for i in range(150, 160))
    assert all(0 <= r.score <= 1 for r in got)
    blank = train_and_score(docs, labels.limit(0), workspace).collect()
    assert {round(r.score, 9) for r in blank} == {0.5}
    assert train_and_score(docs.limit(0), labels, workspace).collect() == []
    assert add_features(docs).columns.count("features") == 1


def test_features_of_single_texts():
    found = text_features(pa.array(["Aa bb. bb.\nline\nline\n", None, ""]))
    first = dict(zip(FEATURES, found[0].tolist(), strict=True))
    assert first["log_words"] == pytest.approx(np.log1p(5))
    assert first["distinct_words"] == pytest.approx(3 / 5)
    assert first["distinct_lines"] == pytest.approx(2 / 3)
    assert first["words_with_stop"] == pytest.approx(2 / 5)
    assert first["share_upper"] == pytest.approx(1 / 21)
    assert found[1].tolist() == found[2].tolist() == [0.0] * len(FEATURES)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


# Fingerprints


def test_fingerprint_survives_edits_but_not_other_texts():
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"{rng.integers(0, 10**6):x}" for _ in range(600))
    one, two = text(), text()
    changed = one[:1500] + "inserted" + one[1530:]
    a, b, c = fingerprints(pa.array([one, changed, two]))
    size, first, second = a.split(":")
    assert int(size) % 3 == 0 and 16 <= len(first) <= 64 and len(second) <= len(first)
    shared = sum(x == y for x, y in zip(first[:10], b.split(":")[1][:10], strict=True))
    assert shared >= 8
    assert a != c


def test_fingerprint_does_not_depend_on_neighbours():
    texts = ["some text of a few words " * 40, "", None, "ab", "é" * 500, "x" * 100_000, "other words here " * 90]
    together = fingerprints(pa.array(texts))
    assert together == [fingerprints(pa.array([t], pa.string()))[0] for t in texts]
    assert together[1] == together[2] == "3::"


def test_likeness(spark):
    pairs = [
        ("3:abcd:ab", "3:abcd:ab", 1.0),
        ("3:abcd:ab", "3:abcx:zz", 0.75),
        ("6:abcd:ab", "3:zzzz:abcd", 1.0),
        ("3:zzzz:abcd", "6:abcd:ab", 1.0),
        ("3:abcd:ab", "12:abcd:ab", 0.0),
        ("3::", "3::", 1.0),
        ("3::", "3:ab:", 0.0),
    ]
    rows = spark.createDataFrame(pairs, "a string, b string, want double")
    for r in rows.withColumn("got", likeness("a", "b")).collect():
        assert r.got == pytest.approx(r.want)


def brute_next(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    for (doc_id, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        changed = edited(text or "", following or "")
        yield doc_id, len(text or ""), hashlib.sha256(changed.encode()).hexdigest()


def test_op8_compares_each_document_with_the_next(spark):
    rows = [(r.doc_id, r.text) for r in whole(spark)]
    got = QUERIES["op8_fingerprints"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(brute_next(rows))
    texts = dict(rows)
    prints = dict(zip(texts, fingerprints(pa.array(list(texts.values()))), strict=True))
    assert all(r.fingerprint == prints[r.doc_id] for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    long = [r for r in got if r.n_chars > 300]
    assert np.median([r.near_edited for r in long]) > 0.5 > 3 * np.median([r.near_next for r in long])


def test_fingerprints_of_odd_rows(spark):
    rows = [(5, "five " * 200), (4, None), (3, ""), (2, "two"), (1, "x" * 200_000)]
    got = compare_with_next(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(brute_next(rows))
    alone = compare_with_next(documents(spark, rows[:1])).collect()
    assert [r.next_fingerprint for r in alone] == [r.fingerprint for r in alone]
    tied = compare_with_next(documents(spark, [(1, "a b c"), (1, "a b c"), (1, "d e f"), (None, "n")])).collect()
    assert sorted((r.doc_id or 0) for r in tied) == [0, 1, 1, 1]
    assert compare_with_next(documents(spark, [])).collect() == []
    kept = fingerprint_documents(documents(spark, rows).withColumn("fingerprint", F.lit(1)))
    assert kept.columns.count("fingerprint") == 1 and kept.count() == 5
