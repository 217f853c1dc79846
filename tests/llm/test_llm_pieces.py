import hashlib

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from sitequarry.llm.piece_table import PieceModel, decode_pieces, encode_pieces, read_model
from tests.llm.conftest import documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "",
    " ",
    "  ",
    "a",
    " a",
    "a ",
    "a  b",
    "\n\n",
    "\t\ttab",
    "héllo wörld 😀",
    "▁x",
    "<s> hi </s> <unk>",
    "     five",
    "日本語のテキスト",
    "\x00\x01",
    "x" * 20000,
    " ".join(["Tokens", "again"] * 3000),
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return PieceModel(read_model(MODEL))


def test_table_equals_library_on_odd_texts(model, library):
    for text in ODD:
        ids = model.encode(text)
        assert ids == library.encode(text), text[:40]
        assert model.decode(ids) == library.decode(ids)


def test_table_equals_library_on_documents(model, library):
    texts = [
        r[0] or ""
        for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    ]
    for text in texts:
        ids = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_last_token_is_unique(model):
    """Exactly one match at each prefix is compatible with its predecessor: the table's premise."""
    text = "▁unbelievable▁antidisestablishmentarianism▁▁▁spaces"
    found = {}
    for stop, (piece, size) in model.automaton.iter(text):
        found.setdefault(stop + 1, []).append((piece, size))
    last = {0: None}
    for prefix in sorted(found):
        fits = [
            (p, s)
            for p, s in found[prefix]
            if prefix == s or model.compatible(last[prefix - s][0], p)
        ]
        assert len(fits) == 1
        last[prefix] = fits[0]


def test_spark_columns_nulls_and_clashes(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "a  b"), (None, "no id")]
    docs = documents(spark, rows)
    docs = docs.withColumn("piece_ids", docs["lang"])
    docs = docs.withColumn("decoded", docs["source"])
    encoded = encode_pieces(docs, MODEL)
    out = decode_pieces(encoded, MODEL).collect()
    assert len(out) == len(rows)
    assert set(docs.columns) == set(encoded.columns)
    for row in out:
        text = row["text"] or ""
        assert row["piece_ids"] == library.encode(text)
        assert row["decoded"] == library.decode(library.encode(text))
        assert row["lang"] == "en"


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    assert decode_pieces(encode_pieces(docs, MODEL), MODEL).count() == 0


def test_query_digests(spark, library):
    from sitequarry.llm.queries import op11_piece_codes

    got = {r["doc_id"]: r for r in op11_piece_codes(spark, "/root/testdata/sf0.001").collect()}
    rows = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode(text or "")
        row = got[doc_id]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_decoded_in_the_same_pass(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None)]
    out = encode_pieces(documents(spark, rows), MODEL, "ids", "back").collect()
    for row in out:
        assert row["back"] == library.decode(library.encode(row["text"] or ""))
