"""One query per operator, over the whole ``documents`` table, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm.decontaminate import find_contamination
from sitequarry.llm.fingerprint import compare_with_next, likeness
from sitequarry.llm.language_id import train_and_identify
from sitequarry.llm.line_dedup import dedup_lines
from sitequarry.llm.near_dedup import near_duplicate_classes
from sitequarry.llm.packing import pack_documents
from sitequarry.llm.piece_table import encode_pieces
from sitequarry.llm.prefix_trie import conversation_trie
from sitequarry.llm.quality import train_and_score
from sitequarry.llm.spelling import spelling_forms
from sitequarry.llm.substring_dedup import remove_repeats
from sitequarry.llm.token_counts import count_tokens
from sitequarry.llm.token_files import read_tokens, write_tokens
from sitequarry.operators.lineage import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TOKEN_LIMIT = 512
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(documents(spark, sf_dir), TOKENIZER, Workspace(spark))


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, from the counts at all its prefixes."""
    counted = count_tokens(documents(spark, sf_dir), TOKENIZER, TOKEN_LIMIT)
    over = (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    return counted.select("doc_id", "n_bytes", "n_tokens", over, "fitting_chars")


@query()
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written and read back."""
    path = f"{Workspace(spark).path}/token-files"
    write_tokens(documents(spark, sf_dir), TOKENIZER, path)
    return read_tokens(spark.read.parquet(path))


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT *, {_FOLD.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM lines
), repeated AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.*, coalesce(k.doc_id > r.first_doc, false) AS gone
  FROM keyed k LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines dropped from all documents but the first."""
    kept = dedup_lines(documents(spark, sf_dir), Workspace(spark))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_dropped", digest)


_WORDS = (
    "regexp_extract_all("
    + _FOLD.format("coalesce(text, '')")
    + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query(
    rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM (SELECT item_id, words, least(len(words), 10) AS n,
      unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i
    FROM items WHERE len(words) > 0)
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i
    FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(words) >= n)
), hits AS (
  SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, w)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a benchmark window, and the items hit."""
    found = find_contamination(
        documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), Workspace(spark)
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query(
    r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 34)) AS i
    FROM docs WHERE len(words) >= 35)
), repeated AS (
  SELECT doc_id, i FROM windows
  WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 34)) AS p FROM repeated
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM docs
), marked AS (
  SELECT w.*, g.p IS NOT NULL AS gone FROM words w LEFT JOIN gone g USING (doc_id, p)
), sums AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM docs d LEFT JOIN sums USING (doc_id)
"""
)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that occur elsewhere, removed."""
    removed = remove_repeats(documents(spark, sf_dir), Workspace(spark))
    return removed.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates that each document belongs to."""
    classes = near_duplicate_classes(documents(spark, sf_dir), Workspace(spark))
    return classes.select("doc_id", "class_id")


@query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document, learned from four of five folds."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = train_and_identify(rows, Workspace(spark))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document, learned from three of four folds of the labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    found = train_and_score(documents(spark, sf_dir), labels, Workspace(spark))
    return found.select("doc_id", "held_out", "score", "predicted")


@query()
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, and its likeness to an edited text's and the next document's."""
    compared = compare_with_next(documents(spark, sf_dir))
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


@query()
def op11_piece_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text through the prefix table, and the text decoded from them."""
    decoded = encode_pieces(documents(spark, sf_dir), PIECE_MODEL, "piece_ids", "decoded")
    return decoded.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations, with members, leaves and saved bytes."""
    trie = conversation_trie(table(spark, sf_dir, "conversations"), Workspace(spark))
    return trie.drop("key")


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven or more letters seen twice, its likelier spelling one edit away, and its root."""
    return spelling_forms(documents(spark, sf_dir), Workspace(spark))
