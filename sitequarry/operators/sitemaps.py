"""Sitemap discovery: location extraction, nested closure, filters and caps."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.text import trim_all
from sitequarry.functions.urls import (
    decode_xml_entities,
    href,
    normalize_path,
    normalize_url,
    path_depth,
    path_locale,
    url_parts,
    url_path,
)
from sitequarry.operators.computed import with_computed
from sitequarry.operators.lineage import Workspace
from sitequarry.operators.skew import number_rows, spread_join

ROUNDS_PER_TABLE = 4


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, pos, loc, is_sitemap) of the readable sitemaps.

    Of several readable captures of a sitemap the one with the least text counts.
    """
    found = F.regexp_extract_all("xml", F.lit("<loc>(.*?)</loc>"), F.lit(1))
    loc = F.col("loc")
    place = Window.partitionBy("sitemap_url").orderBy("xml")
    return (
        sitemaps.filter(F.col("status").between(200, 299))
        .withColumn("_place", F.row_number().over(place))
        .filter("_place = 1")
        .select("sitemap_url", F.posexplode(found).alias("pos", "loc"))
        .withColumn("loc", decode_xml_entities(trim_all(loc)))
        .withColumn(
            "is_sitemap", F.endswith(loc, F.lit(".xml")) | F.endswith(loc, F.lit(".xml.gz"))
        )
    )


def sitemap_closure(starts: DataFrame, sitemaps: DataFrame, workspace: Workspace) -> DataFrame:
    """(site, path_pos, url): page URLs of all sitemaps a site reaches, as an ordered bag.

    ``starts`` is (site, pos, sitemap_url).  Each sitemap is read once per site, where a
    depth-first walk meets it first: at its least path of positions.  Rounds lower the
    path of each sitemap until none can be lowered; cycles only lengthen a path, so they
    end by themselves.
    """
    locs = workspace.table(sitemap_locs(sitemaps), "sitemap-locs")
    links = locs.filter("is_sitemap").select("sitemap_url", "pos", F.col("loc").alias("target"))
    keys = ["site", "sitemap_url"]
    found = starts.groupBy(*keys).agg(F.min(F.array("pos")).alias("path_pos"))
    best = changed = workspace.table(found, "sitemaps-start")
    for n in count(1):
        offers = (
            changed.join(links, "sitemap_url")
            .select(
                "site",
                F.col("target").alias("sitemap_url"),
                F.array_append("path_pos", F.col("pos")).alias("path_pos"),
            )
            .groupBy(*keys)
            .agg(F.min("path_pos").alias("path_pos"))
        )
        known = best.withColumnRenamed("path_pos", "_known")
        better = (
            offers.join(known, keys, "left")
            .filter(F.col("_known").isNull() | (F.col("path_pos") < F.col("_known")))
            .drop("_known")
        )
        changed = workspace.table(better, "sitemaps-changed")
        if changed.isEmpty():
            break
        best = best.unionByName(changed).groupBy(*keys).agg(F.min("path_pos").alias("path_pos"))
        if n % ROUNDS_PER_TABLE == 0:
            best = workspace.table(best, "sitemaps-best")
    pages = locs.filter("not is_sitemap")
    listed = best.join(pages, "sitemap_url").select(
        "site", F.array_append("path_pos", F.col("pos")).alias("path_pos"), F.col("loc").alias("url")
    )
    return workspace.table(listed, "sitemap-closure")


def classify_sitemap_urls(urls: DataFrame, sites: DataFrame) -> DataFrame:
    """Add ``norm_url`` and ``skip_reason`` to sitemap URLs.

    ``sites`` is (site, base_url, depth, lang, …) with the language already resolved.
    """
    base = sites.select(
        "site",
        F.col("depth").alias("_depth"),
        F.col("lang").alias("_lang"),
        normalize_url(F.col("base_url")).alias("_norm_base"),
        path_depth(url_path(F.col("base_url"))).alias("_base_depth"),
    )
    locale = path_locale(F.col("_path"))
    wrong_locale = locale.isNotNull() & F.col("_lang").isNotNull() & (locale != F.col("_lang"))
    reason = (
        F.when(F.col("norm_url").isNull(), F.lit("invalid url"))
        .when(F.col("norm_url") == F.col("_norm_base"), F.lit("base url"))
        .when(path_depth(F.col("_path")) - F.col("_base_depth") > F.col("_depth"), F.lit("too deep"))
        .when(wrong_locale, F.lit("locale"))
    )
    joined = spread_join(urls, base, "site", "url", how="inner")
    parts = url_parts(F.col("url"))
    parsed = with_computed(joined, {"_parts": parts})
    named = with_computed(
        parsed,
        {
            "norm_url": href(
                F.struct(
                    *[F.col("_parts")[f].alias(f) for f in ("scheme", "host", "port")],
                    normalize_path(F.col("_parts")["path"]).alias("path"),
                )
            ),
            "_path": F.col("_parts")["path"],
        },
    )
    return named.withColumn("skip_reason", reason).drop(
        "_parts", "_path", "_depth", "_lang", "_norm_base", "_base_depth"
    )


def cap_sitemap_urls(
    classified: DataFrame, sites: DataFrame, workspace: Workspace
) -> tuple[DataFrame, DataFrame]:
    """The kept URLs of each site within its limits, and (site, url) of those beyond.

    ``max_sitemap_urls`` limits a site's list and ``max_pages`` all its pages, of which the base
    page is one; 0 means no limit.  Duplicates count.
    """
    limit = F.least(
        F.when(F.col("max_sitemap_urls") > 0, F.col("max_sitemap_urls")),
        F.when(F.col("max_pages") > 0, F.col("max_pages") - 1),
    )
    limited = sites.select("site", limit.alias("_limit")).filter("_limit IS NOT NULL")
    kept = classified.filter(F.col("skip_reason").isNull()).drop("skip_reason")
    marked = workspace.table(spread_join(kept, limited, "site", "url"), "sitemap-limits")
    numbered = number_rows(
        marked.filter("_limit IS NOT NULL"), "site", [F.col("path_pos")], workspace
    )
    free = marked.filter("_limit IS NULL").drop("_limit")
    within = numbered.filter("position <= _limit").drop("_limit", "position")
    return free.unionByName(within), numbered.filter("position > _limit").select("site", "url")
