"""Connected components of a graph given as pairs, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.operators.lineage import Workspace


def _summary(edges: DataFrame) -> tuple:
    """A few numbers that tell whether a set of edges has changed."""
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 20))).first())


def components(links: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v); a component is named by its least node.

    A round only takes minima and joins them back, so no neighbourhood is gathered; the number of rounds
    grows with the logarithm of the longest path.
    """
    edges = workspace.table(links.filter("u != v").select("u", "v").distinct(), "edges")
    before = None
    while (now := _summary(edges)) != before:
        before = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = workspace.table(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .distinct()
        )
        edges = workspace.table(small, "edges")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.toDF("node", "component").union(roots.select("node", F.col("node").alias("component")))
