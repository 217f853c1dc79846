"""Quality classification by a generalised additive model with pairwise interactions.

Texts become a few dozen numbers (``FEATURES``) in one scan.  The model is trained by cyclic boosting: round
after round, each feature in turn gets a shallow tree on its binned values, added to its lookup table; then the
pairs of features that explain most of what is left get two-dimensional tables in the same way.  A score is the
sum of table entries, put through the logistic function.

Training uses at most about MAX_TRAINING labelled rows, chosen by a hash of doc_id, as numbers only.

Defined cases: a null text counts as empty; labels that are null are not learned from; with no labels every score
is 0.5; repeated labels count as often as they occur; a column of ``docs`` with the name of a result is replaced.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.batches import map_batches, rows_of, slices, utf8, word_hashes, word_spans
from sitequarry.llm.language_id import held_out
from sitequarry.operators.lineage import Workspace

MAX_TRAINING = 100_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, PAIR_ROUNDS, RATE = 120, 60, 0.1
CUT_OFF = 0.7

_CLASSES = {
    "upper": range(ord("A"), ord("Z") + 1),
    "lower": range(ord("a"), ord("z") + 1),
    "digit": range(ord("0"), ord("9") + 1),
    "space": [0x20, *range(0x09, 0x0E)],
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|/\\<>{}[]=_~^",
    "sign": b"#$%&*+@",
}
_CLASS = np.full(256, len(_CLASSES), np.int64)
_CLASS[0x80:] = len(_CLASSES) + 1
for _i, _members in enumerate(_CLASSES.values()):
    _CLASS[list(_members)] = _i
_N_CLASSES = len(_CLASSES) + 2
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True

FEATURES = [
    "log_bytes",
    "log_words",
    "word_length",
    "longest_word",
    "distinct_words",
    "line_length",
    "distinct_lines",
    "words_with_stop",
    *(f"share_{name}" for name in [*_CLASSES, "other", "beyond_ascii"]),
]


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return np.bincount(rows[new], minlength=n)


def text_features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text."""
    data, offsets = utf8(texts)
    n, size = len(texts), np.diff(offsets)
    owner = np.repeat(np.arange(n), size)
    shares = np.bincount(owner * _N_CLASSES + _CLASS[data], minlength=n * _N_CLASSES).reshape(n, -1)
    shares = shares / np.maximum(size, 1)[:, None]
    starts, ends, bounds = word_spans(data, offsets)
    rows, words = rows_of(np.arange(len(starts)), bounds), np.diff(bounds)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, ends - starts)
    stops = np.bincount(rows, weights=_CLASS[data[ends - 1]] == 4, minlength=n) if len(ends) else np.zeros(n)
    line_starts, line_ends, line_bounds = word_spans(data, offsets, _NEWLINE)
    line_rows, lines = rows_of(np.arange(len(line_starts)), line_bounds), np.diff(line_bounds)
    per_word, per_line = np.maximum(words, 1), np.maximum(lines, 1)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(words),
            np.bincount(rows, weights=ends - starts, minlength=n) / per_word,
            np.log1p(longest),
            _distinct(rows, word_hashes(data, starts, ends), n) / per_word,
            np.log1p(size / per_line),
            _distinct(line_rows, word_hashes(data, line_starts, line_ends), n) / per_line,
            stops / per_word,
            shares,
        ]
    ).astype(np.float32)


def add_features(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with an array of FEATURES."""
    names = [c for c in docs.columns if c not in ("text", "features")]

    def compute(batch: pa.RecordBatch):
        for part in slices(batch):
            found = text_features(part.column("text"))
            yield {n: part.column(n) for n in names} | {"features": list(found)}

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names]
    return map_batches(docs, compute, ", ".join([*kinds, "features array<float>"]))


def _shallow_tree(gain_sums: np.ndarray, weights: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Leaf values over ordered bins: split greedily where the squared sum over weight grows most."""
    gradient = np.concatenate([[0], np.cumsum(gain_sums)])
    weight = np.concatenate([[0], np.cumsum(weights)]) + 1e-9
    cuts = [0, len(gain_sums)]

    def worth(a, b):
        return (gradient[b] - gradient[a]) ** 2 / (weight[b] - weight[a] + 1.0)

    for _ in range(leaves - 1):
        best = (1e-6, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = worth(a, at) + worth(at, b) - worth(a, b)
                i = int(gains.argmax())
                best = max(best, (float(gains[i]), int(at[i])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    values = np.zeros(len(gain_sums))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        values[a:b] = (gradient[b] - gradient[a]) / (weight[b] - weight[a] + 1.0)
    return values


def _shallow_grid(gain_sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A tree of two levels over a grid: one cut along an axis, then one along the other on each side."""
    best, found = 0.0, np.zeros_like(gain_sums)
    for flip in (False, True):
        g, w = (gain_sums.T, weights.T) if flip else (gain_sums, weights)
        for cut in range(1, len(g)):
            values = np.empty_like(g)
            for rows in (slice(0, cut), slice(cut, len(g))):
                values[rows] = _shallow_tree(g[rows].sum(axis=0), w[rows].sum(axis=0), 2)
            gain = float((values * g).sum())
            if gain > best:
                best, found = gain, values.T if flip else values
    return found


class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges, self.coarse, self.pairs, self.pair_tables = [], [], [], []
        for column in x.T if len(x) else np.zeros((len(FEATURES), 1)):
            self.edges.append(np.unique(np.quantile(column, np.arange(1, BINS) / BINS)))
            self.coarse.append(np.unique(np.quantile(column, np.arange(1, PAIR_BINS) / PAIR_BINS)))
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        if len(y):
            self._fit(x, y)

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, column, side="right") for e, column in zip(edges, x.T, strict=True)]

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        fine, coarse = self._bins(x, self.edges), self._bins(x, self.coarse)
        total = np.full(len(y), self.base)

        def step(at, n, tree):
            chance = 1 / (1 + np.exp(-total))
            gradient = np.bincount(at, weights=y - chance, minlength=n)
            weight = np.bincount(at, weights=chance * (1 - chance), minlength=n)
            return RATE * tree(gradient, weight)

        for _ in range(ROUNDS):
            for at, table in zip(fine, self.tables, strict=True):
                change = step(at, len(table), _shallow_tree)
                table += change
                total += change[at]
        worth = []
        residual = y - 1 / (1 + np.exp(-total))
        for a, b in combinations(range(len(fine)), 2):
            shape = (len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)
            cells = coarse[a] * shape[1] + coarse[b]
            sums = np.bincount(cells, weights=residual, minlength=shape[0] * shape[1])
            counts = np.bincount(cells, minlength=len(sums))
            worth.append((float((sums**2 / (counts + 10)).sum()), a, b, shape))
        for _, a, b, shape in sorted(worth, reverse=True)[:PAIRS]:
            self.pairs.append((a, b))
            self.pair_tables.append(np.zeros(shape))
        for _ in range(PAIR_ROUNDS):
            for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
                at = coarse[a] * table.shape[1] + coarse[b]
                change = step(
                    at,
                    table.size,
                    lambda g, w, shape=table.shape: _shallow_grid(g.reshape(shape), w.reshape(shape)),
                )
                table += change
                total += change.ravel()[at]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of features."""
        total = np.full(len(x), self.base)
        for at, table in zip(self._bins(x, self.edges), self.tables, strict=True):
            total += table[at]
        coarse = self._bins(x, self.coarse)
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING) -> AdditiveModel:
    """A model of ``label`` from ``labelled`` (doc_id, features, label)."""
    labelled = labelled.filter("label is not null and features is not null")
    share = min(1.0, max_rows / max(labelled.count(), 1))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # At most about max_rows rows of numbers; ordered, as sums of floats depend on the order.
    rows = chosen.select("doc_id", "features", "label").toArrow().sort_by("doc_id")
    x = rows.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return AdditiveModel(x.reshape(-1, len(FEATURES)), rows.column("label").to_numpy().astype(np.float64))


def score_quality(featured: DataFrame, model: AdditiveModel) -> DataFrame:
    """``featured`` (with features) with score, and predicted: whether it reaches CUT_OFF."""
    featured = featured.drop("score", "predicted")
    known = featured.sparkSession.sparkContext.broadcast(model)
    names = featured.columns

    def score(batch: pa.RecordBatch):
        x = batch.column("features").flatten().to_numpy(zero_copy_only=False)
        found = known.value.score(x.reshape(-1, len(FEATURES)))
        yield {n: batch.column(n) for n in names} | {
            "score": found,
            "predicted": (found >= CUT_OFF).astype(np.int32),
        }

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in featured.schema)
    return map_batches(featured, score, f"{kinds}, score double, predicted int")


def train_and_score(
    docs: DataFrame, labels: DataFrame, workspace: Workspace, label: str = "quality", folds: int = 4, fold: int = 2
) -> DataFrame:
    """``docs`` without text, with held_out, features, score and predicted."""
    featured = docs.drop("features", "score", "predicted").withColumn("held_out", held_out(folds, fold))
    featured = workspace.table(add_features(featured), "features")
    known = labels.select("doc_id", F.col(label).alias("label"))
    labelled = featured.filter("not held_out").select("doc_id", "features").join(known, "doc_id")
    return score_quality(featured, train(labelled))
