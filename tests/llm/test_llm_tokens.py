"""Token counts, packing and token files against the tokenizers library and plain Python."""

import random
import zlib

import numpy as np
import pytest

from llm.conftest import documents
from sitequarry.llm.bpe import Encoder, PrefixCounter
from sitequarry.llm.packing import cut_documents, pack_documents, pack_pieces, sequences, shortest_pack_first
from sitequarry.llm.queries import QUERIES
from sitequarry.llm.token_counts import (
    count_tokens,
    fitting_prefix,
    pack_counts,
    prefix_within,
    read_spec,
    tokens_in_prefix,
    unpack_counts,
)
from sitequarry.llm.token_files import TokenFile, read_tokens, write_file, write_tokens
from sitequarry.llm.wavelet import BitPlane, WaveletMatrix
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

TEXTS = [
    "Hello world, it's we'll they've  two   spaces\n\n\nand\t\ttabs \n x",
    "",
    "   ",
    "<|endoftext|>",
    "ab <|endoftext|> cd  <|endoftext|><|endof",
    "日本語 テキスト👩‍👩‍👧 naïve café ½ ² x²",
    "a" * 300,
    "'ll're 'lll '' 's'st",
    "=" * 90 + "----",
    "12345678901234567890   x  y ​ z  q",
    "def f(x):\n    return x  \n\n\n",
]


def whole(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()


def test_every_prefix_has_the_librarys_count(library, tokenizer_path):
    counter = PrefixCounter(read_spec(tokenizer_path))
    for text, counts in zip(TEXTS, counter.counts(TEXTS), strict=True):
        prefixes = [text[: i + 1] for i in range(len(text))]
        expected = [len(e.ids) for e in library.encode_batch(prefixes, add_special_tokens=False)]
        assert counts.tolist() == expected, text
        assert unpack_counts(pack_counts(counts)).tolist() == expected


def test_encoder_equals_library(library, tokenizer_path, monkeypatch):
    monkeypatch.setattr("sitequarry.llm.bpe.MAX_PIECES", 40)
    encoder = Encoder(read_spec(tokenizer_path))
    for _ in range(2):
        for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
            expected = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == expected


def test_pattern_agrees_on_every_sure_character(library):
    from sitequarry.llm.bpe import patterns

    cut, unsure = patterns()
    for c in range(0, 0x10000):
        if 0xD800 <= c < 0xE000 or unsure.search(chr(c)) or (c > 0x500 and c % 7):
            continue
        text = f"a{chr(c)}b {chr(c)}1{chr(c)} ."
        spans = library.pre_tokenizer.pre_tokenize_str(text)
        assert cut.findall(text) == [text[a:b] for _, (a, b) in spans], hex(c)


def test_op2_counts_whole_table(spark, library):
    got = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, SF).collect()}
    rows = whole(spark, SF)
    assert len(got) == len(rows)
    for doc_id, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        row = got[doc_id]
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(text.encode()), n, n > 512)


def test_kept_counts_answer_budget_and_truncation(spark, library, tokenizer_path):
    docs = documents(spark, [*enumerate(TEXTS), (99, None)]).withColumn("n_tokens", F.lit("clash"))
    kept = count_tokens(docs, tokenizer_path, 5, keep_counts=True)
    assert kept.columns.count("n_tokens") == 1
    asked = kept.select(
        "text",
        "n_tokens",
        "fitting_chars",
        tokens_in_prefix("prefix_counts", F.lit(7)).alias("at_7"),
        prefix_within("prefix_counts", F.lit(5)).alias("within"),
    )
    for row in asked.collect():
        text = row.text or ""
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
        assert row.n_tokens == count(text)
        assert row.at_7 == count(text[:7])
        assert row.within == row.fitting_chars
        assert count(text[: row.within]) <= 5
        assert all(count(text[:i]) > 5 for i in range(row.within + 1, len(text) + 1))


def test_fitting_prefix_of_falling_counts():
    assert fitting_prefix(np.array([1, 2, 1, 2, 3]), 1) == 3
    assert fitting_prefix(np.array([2, 3]), 1) == 0
    assert fitting_prefix(np.zeros(0, int), 1) == 0


def check_packing(rows, texts, library, capacity, end_id=1):
    """Each token in one piece, and each sequence filled without gaps."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [end_id]
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            own = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(own)
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence)


def test_op1_packs_whole_table_with_little_padding(spark, library):
    rows = QUERIES["op1_packing"](spark, SF).collect()
    n = check_packing(rows, dict(whole(spark, SF)), library, 2048)
    assert n * 2048 <= 1.03 * sum(r.length for r in rows) + 2048


def test_packing_of_nulls_repeats_and_long_texts(spark, library, tokenizer_path, workspace):
    texts = {1: None, 2: "", 3: "word " * 500, 4: "word " * 500, 5: "x"}
    docs = documents(spark, texts.items()).withColumn("offset", F.lit("clash"))
    for name in ("_salt", "_rank", "_before", "__salt"):
        docs = docs.withColumn(name, F.lit(f"kept {name}"))
    packed = pack_documents(docs, tokenizer_path, workspace, capacity=64, with_ids=True)
    assert {"lang", "source", "offset"} <= set(packed.columns)
    for name in ("_salt", "_rank", "_before", "__salt"):
        assert {r[name] for r in packed.select(name).collect()} == {f"kept {name}"}
    rows = packed.collect()
    check_packing(rows, texts, library, 64)
    tokens = {r.sequence_id: r.ids for r in sequences(packed).collect()}
    for r in rows:
        assert tokens[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    twice = pack_documents(docs.union(docs), tokenizer_path, workspace, capacity=64).collect()
    assert len(twice) == 2 * len(rows)
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert pack_documents(docs.limit(0), tokenizer_path, workspace).collect() == []


def test_cut_documents_without_columns_but_text(spark, tokenizer_path):
    docs = documents(spark, [(1, "a b")]).select("text")
    assert cut_documents(docs, tokenizer_path).columns == ["start", "length", "ids_crc32", "doc_tokens"]


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 100): rng.randint(1, 2000) for _ in range(40)}
    packs = shortest_pack_first(histogram, 100)
    held = {}
    for count, pattern in packs:
        assert sum(length * n for length, n in pattern) <= 100
        for length, n in pattern:
            held[length] = held.get(length, 0) + n * count
    assert held == histogram
    total = sum(k * v for k, v in histogram.items())
    assert sum(c for c, _ in packs) <= 1.3 * total / 100 + 1
    assert len(packs) <= 4 * 100


def test_hot_length_gets_distinct_places(spark, workspace):
    pieces = spark.range(5000).select(F.lit(3).cast("long").alias("length"), F.col("id").alias("doc_id"))
    rows = pack_pieces(pieces, workspace, ["doc_id"], capacity=10).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5000
    assert len({r.sequence_id for r in rows}) == 1667


def test_bit_plane_rank_and_select():
    rng = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        bits = rng.random(n) < 0.3
        plane = BitPlane(np.packbits(bits, bitorder="little"), n)
        assert plane.bits().tolist() == bits.tolist()
        assert plane.rank(np.arange(n + 1)).tolist() == [int(bits[:i].sum()) for i in range(n + 1)]
        for bit in (0, 1):
            places = np.flatnonzero(bits == bool(bit))
            assert plane.select(np.arange(len(places)), bit).tolist() == places.tolist()


@pytest.mark.parametrize("dtype", [np.uint16, np.uint32])
def test_wavelet_matrix_queries(dtype):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 37, 2000).astype(dtype)
    matrix = WaveletMatrix.of(values, 6)
    assert matrix.values(dtype).tolist() == values.tolist()
    at = rng.integers(0, 2000, 100)
    assert matrix.access(at).tolist() == values[at].tolist()
    which = rng.integers(0, 40, 100)
    expected = [int((values[:a] == w).sum()) for a, w in zip(at, which, strict=True)]
    assert matrix.rank(which, at).tolist() == expected
    for value in (0, 5, 36, 39):
        assert matrix.locate(value).tolist() == np.flatnonzero(values == value).tolist()


@pytest.mark.parametrize("n", [1, 2, 70_000])
def test_token_file_round_trip(n):
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype("<u4")
    file = TokenFile(write_file(ids, [n]))
    assert file.tokens().tolist() == ids.tolist()
    some = rng.integers(0, n, 50)
    assert file.access(some).tolist() == ids[some].tolist()
    for token in (1, 2, 49_999, 77_777):
        assert file.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
        assert file.count(token) == int((ids == token).sum())
        assert file.count(token, n // 3, n // 2) == int((ids[n // 3 : n // 2] == token).sum())


def test_op10_returns_what_the_library_gives(spark, library):
    got = {r.doc_id: r for r in QUERIES["op10_token_files"](spark, SF).collect()}
    start = 0
    for doc_id, text in sorted(whole(spark, SF)):
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        row = got.pop(doc_id)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_token_files_of_nulls_ties_and_small_shards(spark, library, tokenizer_path, workspace, monkeypatch):
    monkeypatch.setattr("sitequarry.llm.token_files.SHARD_TOKENS", 50)
    rows = [(None, "null id"), (3, None), (3, "tie"), (1, ""), (2, "long " * 100), (2, "long " * 100)]
    path = f"{workspace.path}/files"
    write_tokens(documents(spark, rows), tokenizer_path, path)
    got = read_tokens(spark.read.parquet(path), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 3, 3]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted(map(tuple, (r.ids for r in got))) == sorted(
        tuple(library.encode(t or "", add_special_tokens=False).ids) + (0,) for _, t in rows
    )
    empty = f"{workspace.path}/empty"
    write_tokens(documents(spark, []), tokenizer_path, empty)
    assert read_tokens(spark.read.parquet(empty)).collect() == []


def test_encoder_looks_each_piece_up_once_and_forgets_long_ones(library, tokenizer_path, monkeypatch):
    encoder = Encoder(read_spec(tokenizer_path))
    monkeypatch.setattr("sitequarry.llm.bpe.MAX_TEXTS", 0)
    texts = ["a b " + "x" * 50 + " c", "", "b a c", "<|endoftext|>", "z" * 60, "z" * 60 + " new"]
    for some in (texts, texts[::-1], texts):
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert max(map(len, encoder.known)) <= 40
        # Numbers without gaps, and only the ids of kept pieces in the flat arrays.
        assert [*encoder.known.values()] == [*range(len(encoder.known))]
        kept = sum(len(library.encode(p, add_special_tokens=False).ids) for p in encoder.known)
        assert encoder.ids.used == kept and encoder.ends.used == len(encoder.known) + 1


def test_encoder_looks_up_each_different_piece_once_a_call(library, tokenizer_path):
    looked_up = []

    class Counted(dict):
        def __getitem__(self, piece):
            looked_up.append(piece)
            return super().__getitem__(piece)

        def __missing__(self, piece):
            self[piece] = number = len(self)
            return number

    encoder = Encoder(read_spec(tokenizer_path))
    encoder.known = Counted()
    texts = ["the cat  and the dog's " * 50, "the dog's\n the cat", "é the é"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(looked_up) == len(set(looked_up)) > 5


def _odd_texts(seed, n):
    """Texts from few characters, so that the rules of the pattern meet each other and text ends."""
    rng = random.Random(seed)
    alphabet = [*"''''   sstmdrevla19.!\n\t", "\u00a0", "\u3000", "\u1680", "é", "ß", "²", "Ж", "日", "\u0301", "’"]
    alphabet += ["'ll", "'re", "'ve", "'s", "don't", "  "]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_piece_starts_equal_the_pattern(seed):
    from sitequarry.llm.bpe import _kinds, code_points, patterns, piece_starts

    cut, unsure = patterns()
    ascii_only = [t for t in _odd_texts(seed, 3000) if t.isascii()]
    for texts in (_odd_texts(seed, 3000), ascii_only, ["", "", "a", ""], [""], []):
        assert not any(map(unsure.search, texts))
        data, codes, bounds = code_points(texts)
        assert data.decode() == "".join(texts) and bounds[-1] == len(codes)
        starts = piece_starts(codes, _kinds().take(codes, mode="clip"), bounds).tolist()
        joined = data.decode()
        got = [joined[a:b] for a, b in zip(starts, [*starts[1:], len(codes)], strict=False)]
        assert got == [piece for text in texts for piece in cut.findall(text)]


def test_kinds_are_those_of_the_pattern():
    from sitequarry.llm.bpe import _UNSURE, _kinds, patterns

    unsure = patterns()[1]
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    assert [bool(unsure.search(chr(c))) for c in points] == (_kinds()[points] == _UNSURE).tolist()
    assert _kinds()[-1] == _UNSURE and unsure.search("\U00010000")


@pytest.mark.parametrize("seed", range(3))
def test_encoder_equals_library_on_odd_texts(seed, library, tokenizer_path):
    encoder = Encoder(read_spec(tokenizer_path))
    texts = _odd_texts(seed, 2000) + TEXTS
    # Some are left to the library: unsure characters, the byte 0, the added token.
    texts += [t + x for t in _odd_texts(seed + 9, 300) for x in ("👩", "\0", "<|endoftext|>", "\ufffe", "\x7f")]
    random.Random(seed).shuffle(texts)
    for at in range(0, len(texts), 700):
        some = texts[at : at + 700]
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_encoder_without_the_letters_of_all_bytes(library, tokenizer_path):
    """Where the bytes of the tokens do not add up, each piece is given to the library by itself."""
    encoder = Encoder(read_spec(tokenizer_path))
    encoder.sizes = encoder.sizes + 1
    for text, ids in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
