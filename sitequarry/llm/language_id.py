"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training sums n-gram counts by language on all executors, over at most about ``per_language`` documents
of each language (chosen by a hash of doc_id).  The matrix of log-probabilities is broadcast: its size is
2**BITS times the number of languages.  A batch is scored by looking its n-grams up in the matrix and adding
the rows up by text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no training rows every text
is; rows with a null lang or null doc_id are not learned from; a column of ``docs`` with the name of a result is
replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.batches import map_batches, slices, utf8, window_starts
from sitequarry.llm.cells import sum_cells
from sitequarry.operators.lineage import Workspace

BITS = 16
SIZES = (1, 2, 3, 4)
PER_LANGUAGE = 20_000
UNKNOWN = "und"
#: Text scored at a time: each n-gram takes a row of the matrix, some 50 bytes for each byte of text.
SLICE_BYTES = 1 << 18
_KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and letterness of the code points of the first plane."""
    every = [chr(c) for c in range(0x10000)]
    lower = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every]
    return np.array(lower, np.uint32), np.array([c.isalpha() for c in every])


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, bounds by row, and which rows have a letter."""
    data, offsets = utf8(texts)
    codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    lower, letter = _tables()
    low = np.minimum(codes, 0xFFFF)
    letters = letter[low] & (codes < 0x10000)
    far = np.flatnonzero(codes >= 0x10000)
    letters[far] = [chr(c).isalpha() for c in codes[far].tolist()]
    before = np.concatenate([[0], np.cumsum(letters)])
    return np.where(codes < 0x10000, lower[low], codes), bounds, before[bounds[1:]] > before[bounds[:-1]]


def ngrams(codes: np.ndarray, bounds: np.ndarray):
    """For each n: the cells of all n-grams within rows, and their bounds by row."""
    for n in SIZES:
        if len(codes) < n:
            continue
        total = np.full(len(codes) - n + 1, n, np.uint32)
        for i in range(n):
            total = (total ^ codes[i : i + len(total)]) * _KEYS[i]
            total ^= total >> np.uint32(15)
        total *= np.uint32(0x2545F491)
        counts = np.maximum(np.diff(bounds) - n + 1, 0)
        at = window_starts(bounds, n)
        yield (total[at] >> np.uint32(32 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def held_out(folds: int, fold: int) -> Column:
    """Whether a document is kept from training: the remainder of its doc_id's checksum."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(rows: DataFrame, workspace: Workspace, per_language: int = PER_LANGUAGE):
    """(languages, log-probabilities by cell and language, log priors) of ``rows`` (doc_id, text, lang)."""
    rows = rows.filter("lang is not null and doc_id is not null")
    sizes = dict(rows.groupBy("lang").count().collect())  # one row per language
    languages = sorted(sizes)
    shares = rows.sparkSession.createDataFrame(
        [(lang, min(1.0, per_language / n)) for lang, n in sizes.items()], "lang string, share double"
    )
    chosen = rows.join(shares, "lang").filter(
        F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    )

    def count(batch: pa.RecordBatch):
        for part in slices(batch, size=SLICE_BYTES):
            codes, bounds, _ = code_points(part.column("text"))
            names, which = np.unique(np.array(part.column("lang").to_pylist(), object), return_inverse=True)
            totals = np.zeros(len(names) << BITS, np.int64)
            for cells, by_row in ngrams(codes, bounds):
                owner = np.repeat(which, np.diff(by_row)) << BITS
                totals += np.bincount(owner + cells, minlength=len(totals))
            yield from zip(names, totals.reshape(len(names), -1), strict=True)

    counts = sum_cells(chosen.select("lang", "text"), count, 1 << BITS, workspace)
    matrix = np.stack([counts.get(lang, np.zeros(1 << BITS)) for lang in languages] or [np.zeros(1 << BITS)], 1)
    matrix = np.log((matrix + 0.5) / (matrix.sum(axis=0) + 0.5 * len(matrix)))
    priors = np.log([sizes[lang] / sum(sizes.values()) for lang in languages])
    return languages, matrix.astype(np.float32), priors


def identify(docs: DataFrame, model) -> DataFrame:
    """``docs`` with lang_pred and score, the chance the model gives to that language."""
    docs = docs.drop("lang_pred", "score")
    known = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def score(batch: pa.RecordBatch):
        languages, matrix, priors = known.value
        labels = np.array([*languages, UNKNOWN], object)
        for part in slices(batch, size=SLICE_BYTES):
            codes, bounds, lettered = code_points(part.column("text"))
            if not languages:
                lettered[:] = False
            total = np.tile(priors, (part.num_rows, 1)) if languages else np.zeros((part.num_rows, 1))
            for cells, by_row in ngrams(codes, bounds):
                some = np.flatnonzero(np.diff(by_row))
                if len(some):
                    sums = np.add.reduceat(matrix[cells], by_row[:-1][some], axis=0, dtype=np.float64)
                    total[some] += sums
            best = total.argmax(axis=1)
            chance = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            yield {n: part.column(n) for n in names} | {
                "lang_pred": labels[np.where(lettered, best, len(languages))].tolist(),
                "score": np.where(lettered, chance, 0.0),
            }

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_batches(docs, score, f"{kinds}, lang_pred string, score double")


def train_and_identify(docs: DataFrame, workspace: Workspace, folds: int = 5, fold: int = 0) -> DataFrame:
    """Learn from all folds but one and predict for every row; adds held_out, lang_pred and score.

    The prediction reads the text alone."""
    model = train(docs.filter(~held_out(folds, fold)).select("doc_id", "text", "lang"), workspace)
    return identify(docs.withColumn("held_out", held_out(folds, fold)), model)
