"""A training corpus from raw documents: language, repeated lines, near copies, leaked tests, packing.

Each stage takes what its predecessor kept, written as Parquet and read back, so a lost executor costs at most
the stage at hand.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm.decontaminate import find_contamination
from sitequarry.llm.language_id import UNKNOWN, train_and_identify
from sitequarry.llm.line_dedup import dedup_lines
from sitequarry.llm.near_dedup import drop_near_duplicates
from sitequarry.llm.packing import pack_documents
from sitequarry.operators.lineage import Workspace

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: A document stays if the model finds one language more likely than all others together.
MIN_LANGUAGE_SCORE = 0.5
PACKED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

#: A trained model and a tokenizer have no SQL form; the result is tested against a brute-force version.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which the model recognises a language."""
    found = train_and_identify(docs.select("doc_id", "text", "lang"), Workspace(spark))
    # The prediction travels with the row; only columns of ``docs`` are kept.
    certain = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    rejected = found.filter(~certain).select("doc_id", F.xxhash64("text").alias("version")).distinct()
    rejected = Workspace(spark).table(rejected, "rejected")
    same = docs["doc_id"].eqNullSafe(rejected["doc_id"]) & (F.xxhash64(docs["text"]) == rejected["version"])
    return docs.join(rejected, same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that an earlier one holds."""
    kept = dedup_lines(docs, Workspace(spark))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return drop_near_duplicates(docs, Workspace(spark))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark, Workspace(spark), remove="documents")
    return found.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of all documents in sequences of 2048."""
    return pack_documents(docs.select("doc_id", "text"), TOKENIZER, Workspace(spark)).select(*PACKED)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder."""
    docs, workspace = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark)
    for name, stage in STAGES:
        docs = workspace.table(stage(spark, docs, sf_dir), name)
    return docs
