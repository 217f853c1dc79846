"""The pipeline stage by stage against plain Python, and as a whole."""

import re
from collections import Counter

import pyarrow as pa
from llm.conftest import documents
from llm.test_llm_dedup import brute_classes, brute_lines
from llm.test_llm_tokens import check_packing

import corpus_pipeline
from sitequarry.llm.batches import map_partitions
from sitequarry.llm.bpe import encoder
from sitequarry.llm.packing import cut_documents

SF = "/root/testdata/sf0.001"
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def leaks(text, windows):
    words = ITEM_WORDS.findall(fold(text))
    return any(tuple(words[i : i + n]) in w for n, w in windows.items() for i in range(len(words) - n + 1))


def test_stages_agree_with_brute_force(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}

    def advance(name, docs, expected):
        out = stages[name](spark, docs, SF)
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        assert {r.doc_id: r.text for r in out.collect()} == expected
        return out, expected

    docs, texts = advance("language_id", docs, {i: t for i, t in texts.items() if any(c.isalpha() for c in t or "")})
    docs, texts = advance("line_dedup", docs, {i: t for i, t, _, _ in brute_lines(list(texts.items()))})
    classes, _ = brute_classes(list(texts.items()))
    docs, texts = advance("near_dedup", docs, {i: t for (i, t), c in classes.items() if i == c})
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        words = ITEM_WORDS.findall(fold(r.text))
        n = min(len(words), 10)
        windows.setdefault(n, set()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1) if n)
    docs, texts = advance("decontamination", docs, {i: t for i, t in texts.items() if not leaks(t, windows)})
    packed = stages["packing"](spark, docs, SF).collect()
    check_packing(packed, texts, library, 2048)
    whole = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole) == Counter(
        (r.doc_id, r.start, r.ids_crc32) for r in packed
    )


def test_stages_take_odd_rows_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (3, "123"), (4, "some words here"), (4, "some words here"), (None, "other words"), (5, "w " * 50_000)]
    for docs in (documents(spark, rows), documents(spark, [])):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()


def test_workers_keep_no_pieces_of_another_stage_and_get_small_batches(spark, workspace, tokenizer_path):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = documents(spark, [(i, f"{i} " * 5_000) for i in range(400)]).coalesce(1)
    # Packing fills a cache of pieces; the next stage of the same worker starts without it.
    cut_documents(docs, tokenizer_path).collect()

    def look(batches):
        for batch in batches:
            size = encoder.cache_info().currsize
            yield pa.RecordBatch.from_pydict({"kept": [size], "bytes": [batch.nbytes]})

    seen = workspace.table(map_partitions(docs, look, "kept long, bytes long"), "seen").collect()
    assert {r.kept for r in seen} == {0}
    assert max(r.bytes for r in seen) < 3 << 20 < sum(r.bytes for r in seen)
    assert spark.conf.get(name) == before
