"""robots.txt rules as an index of literal prefixes, met by the paths of distinct URLs.

A rule can only match a path that starts with the literal text before its first ``*``.  The rules become
rows (site, prefix, rule); each distinct (site, path) is cut at the prefix lengths its site's rules have,
and an equi-join on (site, prefix) yields the candidate rules.  Only candidates are matched in full, so the
work grows with paths times the distinct prefix lengths of a site, not with rules times links, and no
pattern is compiled per row.

Defined cases: a page whose site has no rules, or whose path is null, is allowed; the longest matching rule
decides and allow wins a tie, as in ``robots.robots_allow``; repeated pages share one verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.operators.robots import path_matches


def rule_index(rules: DataFrame) -> DataFrame:
    """(site, prefix, allow, pieces, anchored, len): each rule under the literal text before its first ``*``."""
    return rules.select(
        "site",
        F.element_at("pieces", 1).alias("prefix"),
        "allow",
        "pieces",
        "anchored",
        "len",
    )


def indexed_verdicts(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(site, path, allowed) for each distinct (site, path) of ``paths``."""
    index = rule_index(rules)
    lengths = index.groupBy("site").agg(
        F.array_sort(F.collect_set(F.char_length("prefix"))).alias("lengths")
    )
    distinct = paths.select("site", "path").filter(F.col("path").isNotNull()).distinct()
    probes = distinct.join(lengths, "site").select(
        "site",
        "path",
        F.explode(F.filter("lengths", lambda n: n <= F.char_length("path"))).alias("n"),
    )
    probes = probes.select("site", "path", F.expr("substring(path, 1, n)").alias("prefix"))
    candidates = probes.join(index, ["site", "prefix"])
    matched = candidates.filter(path_matches(F.col("path"), F.col("pieces"), F.col("anchored")))
    best = matched.groupBy("site", "path").agg(F.max(F.struct("len", "allow")).alias("best"))
    return distinct.join(best, ["site", "path"], "left").select(
        "site", "path", F.coalesce(F.col("best.allow"), F.lit(True)).alias("allowed")
    )


def robots_indexed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with site and path) and whether robots rules allow each, through the prefix index."""
    verdicts = indexed_verdicts(pages, rules)
    joined = pages.join(verdicts, ["site", "path"], "left")
    return joined.withColumn("allowed", F.coalesce("allowed", F.lit(True)))
