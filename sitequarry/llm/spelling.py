"""Spelling variants: words one edit apart, found by composing finite-state machines, grouped by frequency.

Words are counted with Spark.  Pairs of words one insertion, deletion or substitution apart come from the
composition A . T . A, where A is the minimised acceptor of the vocabulary and T a transducer that copies
its input with exactly one edit: a path of the composition reads a word of A and writes a word of A.  The
composition is walked lazily from its initial state and only paths that reach final states are followed,
so the work grows with the pairs found, not with all pairs of words.

The walk is split by the first three symbols read from the initial state: words that share them form one
machine.  An edit at position three or later keeps those symbols; an edit before it keeps the last three
symbols of words of at least seven (the only ones counted), so the same walk over reversed words, split
by their first three symbols, finds the rest.

A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at
least ``factor`` times its own; its root follows forms to the end, by pointer jumping.

Defined cases: a null text has no runs; a null doc_id makes no deletion (its hash is null); very long texts
are taken whole; an empty table or no word of the least length gives an empty result; columns of ``docs``
other than doc_id and text are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.llm.shipping import ship
from sitequarry.operators.lineage import Workspace

RUN = "[A-Za-zÀ-ÿ]+"
#: Symbols read from the initial state that split the walk; words must have more than twice as many.
SPLIT = 3


def variant_runs(docs: DataFrame, modulus: int = 31) -> DataFrame:
    """(doc_id, word) for every run of letters, A-Z lower-cased, one code point deleted where the crc32 of
    ``doc_id:run`` is divisible by ``modulus`` (at that hash modulo the run's length)."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = docs.select(
        "doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), 0)).alias("run")
    )
    runs = runs.select("doc_id", F.translate("run", upper, lower).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    cut = F.expr(
        "concat(substring(run, 1, cast(crc32(concat(cast(doc_id AS string), ':', run)) % char_length(run) AS int)),"
        " substring(run, cast(crc32(concat(cast(doc_id AS string), ':', run)) % char_length(run) AS int) + 2))"
    )
    return runs.select("doc_id", F.when(h % modulus == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): words of at least ``min_chars`` code points that occur at least ``min_count`` times."""
    runs = variant_runs(docs).filter(F.char_length("word") >= min_chars)
    counts = runs.groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_count)


class Acceptor:
    """The minimal deterministic acceptor of a sorted list of words, built incrementally."""

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        self._register: dict[tuple, int] = {}
        previous = ""
        for word in words:
            common = 0
            while common < min(len(word), len(previous)) and word[common] == previous[common]:
                common += 1
            self._minimise(previous, common)
            state = self._walk(word[:common])
            for char in word[common:]:
                self.edges.append({})
                self.final.append(False)
                self.edges[state][char] = len(self.edges) - 1
                state = len(self.edges) - 1
            self.final[state] = True
            previous = word
        self._minimise(previous, 0)

    def _walk(self, prefix: str) -> int:
        state = 0
        for char in prefix:
            state = self.edges[state][char]
        return state

    def _minimise(self, word: str, keep: int) -> None:
        """Replace the states of ``word`` past ``keep`` symbols by equal registered ones."""
        path = [0]
        for char in word:
            path.append(self.edges[path[-1]][char])
        for depth in range(len(word), keep, -1):
            parent, child, char = path[depth - 1], path[depth], word[depth - 1]
            signature = (self.final[child], tuple(sorted(self.edges[child].items())))
            same = self._register.get(signature)
            if same is None:
                self._register[signature] = child
            elif same != child:
                self.edges[parent][char] = same

    def suffixes(self, state: int) -> list[str]:
        return [text for text, _ in walk_pairs(self, state, state, "")]


def walk_pairs(machine: Acceptor, p: int, q: int, banned: str) -> list[tuple[str, None]]:
    """Common suffixes of the languages of states ``p`` and ``q`` whose first symbol is not ``banned``.

    Paths are kept as parent links and spelled out only when both states are final, so a long word costs
    its length once, not once per symbol."""
    edges, final = machine.edges, machine.final
    links: list[tuple[int, str]] = [(-1, "")]
    found, stack = [], [(p, q, 0)]
    while stack:
        a, b, link = stack.pop()
        if final[a] and final[b]:
            chars, at = [], link
            while at > 0:
                at, char = links[at]
                chars.append(char)
            found.append(("".join(reversed(chars)), None))
        for c, r in edges[a].items():
            s = edges[b].get(c) if a != b else r
            if s is None or (link == 0 and c == banned):
                continue
            links.append((link, c))
            stack.append((r, s, len(links) - 1))
    return found


def one_edit_pairs(words: list[str]) -> set[tuple[str, str]]:
    """Ordered pairs of words one edit apart: the accepted paths of acceptor . one-edit transducer . acceptor.

    A state of the composition is (state of the first acceptor, edit used, state of the second).  Before
    the edit both acceptors read the same symbols, so they are in the same state; after it, the rest must be
    a common suffix of both states' languages.  The transducer deletes or inserts a symbol only at the end
    of a run of equal symbols (the next symbol differs), so each pair has one accepting path."""
    machine = Acceptor(sorted(set(words)))
    edges = machine.edges
    common: dict[tuple[int, int, str], list[str]] = {}

    def after_edit(p: int, q: int, banned: str) -> list[str]:
        if (p, q, banned) not in common:
            common[(p, q, banned)] = [text for text, _ in walk_pairs(machine, p, q, banned)]
        return common[(p, q, banned)]

    pairs: set[tuple[str, str]] = set()
    links: list[tuple[int, str]] = [(-1, "")]

    def spelled(link: int) -> str:
        chars = []
        while link > 0:
            link, char = links[link]
            chars.append(char)
        return "".join(reversed(chars))

    stack = [(0, 0)]
    while stack:
        state, link = stack.pop()
        out = edges[state]
        steps = [(c, d, r, s, "") for c, r in out.items() for d, s in out.items() if c != d]
        steps += [(c, "", r, state, c) for c, r in out.items()]  # deletion, before a different symbol
        steps += [("", d, state, s, d) for d, s in out.items()]  # insertion, likewise
        read = None
        for left, right, p, q, banned in steps:
            for rest in after_edit(p, q, banned):
                read = spelled(link) if read is None else read
                pairs.add((read + left + rest, read + right + rest))
        for c, r in out.items():
            links.append((link, c))
            stack.append((r, len(links) - 1))
    return pairs


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, near) for every ordered pair of vocabulary words one edit apart."""
    ship(vocab.sparkSession)
    forward = vocab.select(F.lit(False).alias("reversed"), F.col("word").alias("spelled"))
    backward = vocab.select(F.lit(True).alias("reversed"), F.reverse("word").alias("spelled"))
    machines = forward.unionByName(backward).withColumn("start", F.substring("spelled", 1, SPLIT))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        pairs = one_edit_pairs(group["spelled"].tolist())
        if bool(group["reversed"].iloc[0]):
            pairs = {(a[::-1], b[::-1]) for a, b in pairs}
        return pd.DataFrame(sorted(pairs), columns=["word", "near"])

    found = machines.groupBy("reversed", "start").applyInPandas(walk, "word string, near string")
    return found.distinct()


def spelling_forms(docs: DataFrame, workspace: Workspace, factor: int = 10) -> DataFrame:
    """Per vocabulary word: word, form, root, n, n_near, form_n."""
    vocab = workspace.table(vocabulary(docs), "spelling-vocabulary")
    pairs = workspace.table(near_pairs(vocab), "spelling-pairs")
    counted = pairs.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"),
    )
    words = vocab.join(best, "word", "left")
    best_n = -F.col("best").getField("col1")
    chosen = F.col("best").isNotNull() & (best_n >= factor * F.col("n"))
    words = workspace.table(
        words.select(
            "word",
            F.when(chosen, F.col("best").getField("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, best_n).alias("form_n"),
        ),
        "spelling-forms",
    )
    # Pointer jumping: each round doubles the length of the followed chain; a chain's counts grow tenfold
    # at each step, so it has fewer steps than the digits of the largest count.
    jumps = words.select("word", F.coalesce("form", "word").alias("to"))
    while True:
        ahead = jumps.alias("a").join(jumps.alias("b"), F.col("a.to") == F.col("b.word"))
        ahead = workspace.table(ahead.select("a.word", F.col("b.to").alias("to")), "spelling-roots")
        if ahead.join(jumps, ["word", "to"], "left_anti").isEmpty():
            break
        jumps = ahead
    return words.join(jumps.withColumnRenamed("to", "root"), "word").select(
        "word", "form", "root", "n", "n_near", "form_n"
    )
