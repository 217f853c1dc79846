"""Which captured pages a site reaches from its base URL, sitemaps and links.

The visit order is by wave: the base page, then sitemap pages, then links one hop further
each wave.  Inside a wave it is the order of the linking pages and the position of the
link on them, kept as an array of positions along the way, which sorts like the queue of
a breadth-first walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.urls import (
    bind,
    href,
    normalize_path,
    normalized_parts,
    resolve_href,
    url_parts,
)
from sitequarry.operators.admission import claim_key, skip_reason
from sitequarry.operators.lineage import Workspace
from sitequarry.operators.skew import number_rows, spread_join

VISIT = ["site", "url", "claim", "depth", "wave", "path_pos", "max_depth", "max_pages",
         "min_content_length"]


def resolved_links(hrefs: Column, page: Column, site: Column) -> Column:
    """ARRAY of STRUCT(pos, parts): same-host http(s) links of a page, duplicates kept."""

    def one(link: Column, pos: Column) -> Column:
        return F.struct(pos.alias("pos"), resolve_href(link, page).alias("parts"))

    return F.filter(F.transform(hrefs, one), lambda x: x["parts"]["host"] == site)


def page_links(pages: DataFrame, policy: DataFrame) -> DataFrame:
    """(url, links ARRAY<STRUCT<pos, url, claim, refusal>>): the same-host links of each page.

    The policy of a site meets each page once, here, and not again in every wave;
    ``refusal`` is the reason a link may not be followed, or NULL.
    """
    rules = policy.select("site", "lang", "include_rx", "exclude_rx", "rules")
    joined = spread_join(pages.select("site", "url", "hrefs"), rules, "site", "url", how="inner")

    def admitted(link: Column) -> Column:
        def checked(parts: Column) -> Column:
            return F.struct(
                link["pos"].alias("pos"),
                href(parts).alias("url"),
                claim_key(href(parts), parts["path"], F.col("lang")).alias("claim"),
                skip_reason(F.col("site"), parts).alias("refusal"),
            )

        parts = link["parts"]
        return bind(parts.withField("path", normalize_path(parts["path"])), checked)

    # a second link to the same target can never be the first to reach it
    found = resolved_links(F.array_distinct("hrefs"), F.col("_base"), F.col("site"))
    return (
        joined.withColumn("_base", url_parts(F.col("url")))
        .withColumn("_found", found)
        .select("url", F.transform("_found", admitted).alias("links"))
    )


def _first_entries(policy: DataFrame, seeds: DataFrame) -> DataFrame:
    """Queue entries before any link: the base page, then sitemap pages at full depth.

    Entries that may not be visited carry the reason as ``refusal``.
    """
    base = policy.select(
        "site",
        F.col("norm_base").alias("url"),
        F.array(F.lit(0)).alias("path_pos"),
        F.lit(0).alias("wave"),
    )
    listed = seeds.select("site", F.col("norm_url").alias("url"), "path_pos", F.lit(1).alias("wave"))
    return (
        base.unionByName(listed)
        .join(policy, "site")
        .withColumn("_parts", normalized_parts(F.col("url")))
        .select(
            "site",
            "url",
            claim_key(F.col("url"), F.col("_parts")["path"], F.col("lang")).alias("claim"),
            F.when(F.col("wave") == 0, F.lit(0)).otherwise(F.col("depth")).alias("depth"),
            "wave",
            "path_pos",
            F.col("depth").alias("max_depth"),
            "max_pages",
            "min_content_length",
            skip_reason(F.col("site"), F.col("_parts")).alias("refusal"),
        )
    )


def _follow(frontier: DataFrame, links: DataFrame, wave: int) -> DataFrame:
    """The links on the pages of a frontier that may still be expanded."""
    return (
        frontier.filter("depth < max_depth")
        .join(links, "url")
        .withColumn("_link", F.explode("links"))
        .select(
            "site",
            F.col("_link.url").alias("url"),
            F.col("_link.claim").alias("claim"),
            (F.col("depth") + 1).alias("depth"),
            F.lit(wave).alias("wave"),
            F.array_append("path_pos", F.col("_link.pos")).alias("path_pos"),
            "max_depth",
            "max_pages",
            "min_content_length",
            F.col("_link.refusal").alias("refusal"),
        )
    )


def refusals(entries: list[DataFrame], visits: DataFrame) -> DataFrame:
    """(site, url, stage, skip_reason) of queue entries that were never visited.

    An admissible URL whose claim went to another URL is a locale duplicate (F8).
    """
    narrow = entries[0].select("site", "url", "claim", "refusal")
    for more in entries[1:]:
        narrow = narrow.unionByName(more.select("site", "url", "claim", "refusal"))
    narrow = narrow.distinct()
    stage = F.lit("admission").alias("stage")
    refused = narrow.filter(F.col("refusal").isNotNull()).select(
        "site", "url", stage, F.col("refusal").alias("skip_reason")
    )
    taken = visits.select("site", "claim", F.col("url").alias("_visited"))
    doubles = (
        narrow.filter(F.col("refusal").isNull())
        .join(taken, ["site", "claim"])
        .filter(F.col("url") != F.col("_visited"))
        .select("site", "url", stage, F.lit("locale duplicate").alias("skip_reason"))
    )
    return refused.unionByName(doubles)


def reach(
    policy: DataFrame, seeds: DataFrame, links: DataFrame, workspace: Workspace
) -> tuple[DataFrame, DataFrame]:
    """Visits (VISIT columns) and refusals.

    Visits are all URLs a site claims, whether or not a page was captured there.

    ``seeds`` is (site, path_pos, norm_url) of capped sitemap URLs; they are visited but
    not followed.  ``links`` comes from ``page_links``, keyed by ``url``.
    """
    frontiers: list[DataFrame] = []

    def visit(candidates: DataFrame) -> DataFrame:
        """First candidate of each claim that no earlier wave has."""
        rest = [c for c in VISIT if c not in ("site", "claim", "path_pos")]
        first = (
            candidates.filter(F.col("refusal").isNull())
            .groupBy("site", "claim")
            .agg(F.min(F.struct("path_pos", *rest)).alias("_first"))
            .select("site", "claim", "_first.*")
        )
        if frontiers:
            claimed = reduce(DataFrame.unionByName, [f.select("site", "claim") for f in frontiers])
            first = first.join(claimed, ["site", "claim"], "left_anti")
        frontier = workspace.table(first.select(*VISIT), f"wave-{len(frontiers)}")
        frontiers.append(frontier)
        return frontier

    entries = [workspace.table(_first_entries(policy, seeds), "entries")]
    frontier = visit(entries[0].filter("wave = 0"))
    visit(entries[0].filter("wave = 1"))
    while not frontier.isEmpty():
        followed = _follow(frontier, links, len(frontiers))
        entries.append(workspace.table(followed, f"entries-{len(entries)}"))
        frontier = visit(entries[-1])
    visits = reduce(DataFrame.unionByName, frontiers)
    return visits, workspace.table(refusals(entries, visits), "refusals")


def cap_visits(fetched: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """At most ``max_pages`` fetched pages per site in visit order, and the pages beyond; 0 means
    all (O5)."""
    limited = fetched.filter("max_pages > 0")
    if limited.isEmpty():
        return fetched, limited
    order = [F.col("wave"), F.col("path_pos")]
    numbered = number_rows(limited, "site", order, workspace)
    within, beyond = (numbered.filter(f"position {op} max_pages") for op in ("<=", ">"))
    return fetched.filter("max_pages <= 0").unionByName(within.drop("position")), beyond
