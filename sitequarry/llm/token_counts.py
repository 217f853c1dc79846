"""Token counts at every prefix of every text, and what follows from them without encoding again.

``bpe.PrefixCounter`` does the dynamic programming, piece by piece; here it runs over a table of documents.
The whole row of counts can be kept in a compact column and asked later: how many tokens has the text cut
at a character, and how much of the text fits into a budget.

Defined cases: a null or empty text has no tokens; a column of ``docs`` with the name of a result is replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.batches import map_batches, slices, utf8
from sitequarry.llm.bpe import prefix_counter


def read_spec(path: str) -> str:
    """A tokenizer file, read on the driver; it goes to the tasks as a broadcast of its size (a few MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts at every prefix as compressed differences."""
    steps = np.diff(counts, prepend=0)
    small = not len(steps) or (steps.min() >= -128 and steps.max() <= 127)
    kind = "<i1" if small else "<i4"
    return kind[1:].encode() + zlib.compress(steps.astype(kind).tobytes(), 1)


def unpack_counts(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data[2:]), f"<{data[:2].decode()}").astype(np.int64))


def fitting_prefix(counts: np.ndarray, budget: int) -> int:
    """Length of the longest prefix that has at most ``budget`` tokens."""
    if not len(counts) or counts[-1] <= budget:
        return len(counts)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def count_tokens(
    docs: DataFrame, tokenizer: str, budget: int, keep_counts: bool = False
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and fitting_chars, the code points of the longest prefix within
    ``budget`` tokens; ``keep_counts`` adds prefix_counts, the packed counts at every prefix."""
    results = {"n_bytes": "bigint", "n_tokens": "bigint", "fitting_chars": "bigint"}
    if keep_counts:
        results["prefix_counts"] = "binary"
    docs = docs.drop("prefix_counts", *results)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))
    names = docs.columns

    def count(batch: pa.RecordBatch):
        counter = prefix_counter(spec.value)
        for part in slices(batch):
            _, offsets = utf8(part.column("text"))
            counts = counter.counts([t or "" for t in part.column("text").to_pylist()])
            found = {
                "n_bytes": np.diff(offsets),
                "n_tokens": [int(c[-1]) if len(c) else 0 for c in counts],
                "fitting_chars": [fitting_prefix(c, budget) for c in counts],
            }
            if keep_counts:
                found["prefix_counts"] = [pack_counts(c) for c in counts]
            yield {name: part.column(name) for name in names} | found

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields} | results
    return map_batches(docs, count, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def tokens_in_prefix(prefix_counts: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` code points, from kept counts."""

    @F.pandas_udf("long")
    def at(packed, ends):
        import pandas as pd

        rows = zip(packed, ends, strict=True)
        return pd.Series([_at(p, e) for p, e in rows], dtype="Int64")

    return at(prefix_counts, n_chars)


def _at(packed: bytes | None, end) -> int | None:
    if packed is None or end is None or end != end:
        return None
    counts = unpack_counts(packed)
    end = min(int(end), len(counts))
    return int(counts[end - 1]) if end > 0 else 0


def prefix_within(prefix_counts: Column, budget: Column) -> Column:
    """Code points of the longest prefix within ``budget`` tokens, from kept counts."""

    @F.pandas_udf("long")
    def within(packed, budgets):
        import pandas as pd

        return pd.Series(
            [
                None if p is None or b is None or b != b else fitting_prefix(unpack_counts(p), int(b))
                for p, b in zip(packed, budgets, strict=True)
            ],
            dtype="Int64",
        )

    return within(prefix_counts, budget)
