"""Per-site facts the index needs, and the columns derived from them.

Everything per site comes from two grouped aggregates over narrow columns, so a site
with very many pages is combined map-side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.sections import HOME, section_of_segment
from sitequarry.functions.text import first_non_empty
from sitequarry.functions.urls import (
    page_segments,
    path_as_written,
    path_segments,
    site_display_name,
)
from sitequarry.operators.skew import spread_join


def url_order() -> list[Column]:
    """Sort key of pages within a site: language-neutral collation, then code points (O1)."""
    return [F.collate("url", "UNICODE").alias("_url_key"), F.col("url")]


def with_second_section(pages: DataFrame) -> DataFrame:
    """Add what regrouping needs: ``second_section`` and whether the page is below the root."""
    return (
        pages.withColumn("_path", path_as_written(F.col("url")))
        .withColumn("_parts", page_segments(F.col("_path")))
        .withColumns(
            {
                "second_section": F.when(F.size("_parts") < 2, F.col("section")).otherwise(
                    section_of_segment(F.get("_parts", F.lit(1)))
                ),
                "_below_root": F.size("_parts") > 0,
                "_has_path": F.size(path_segments(F.col("_path"))) > 0,
                "_is_home": F.col("_path").isin("", "/"),
            }
        )
        .drop("_path", "_parts")
    )


def generic_descriptions(pages: DataFrame, site_counts: DataFrame) -> DataFrame:
    """(site, description, n_pages) of descriptions on at least 2 and 30% of a site's pages.

    Pages without a description count towards the total (A1, A2).  No more than three
    descriptions can reach that share, so only the three most frequent of a site are
    compared with its total; the group limit works map-side.
    """
    by_count = Window.partitionBy("site").orderBy(F.desc("n_pages"), "description")
    frequent = (
        pages.filter(F.col("description") != "")
        .groupBy("site", "description")
        .agg(F.count(F.lit(1)).alias("n_pages"))
        .filter("n_pages >= 2")
        .withColumn("_place", F.row_number().over(by_count))
        .filter("_place <= 3")
        .drop("_place")
    )
    totals = site_counts.select("site", F.col("n_pages").alias("_total"))
    return (
        frequent.join(totals, "site")
        .filter("10 * n_pages >= 3 * _total")
        .select("site", "description", "n_pages")
    )


def site_facts(pages: DataFrame) -> DataFrame:
    """One row per site from pages that carry ``with_second_section``.

    ``visit_order`` columns decide which of two pages at ``/`` is the homepage; without
    them the smaller URL is.
    """
    order = [F.col(c) for c in ("wave", "path_pos") if c in pages.columns]
    home = F.when(F.col("_is_home"), F.struct(*order, "url", "title", "description"))
    return pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.coalesce(
            F.bool_and(F.when(F.col("_below_root"), F.col("section") == HOME)), F.lit(False)
        ).alias("all_home"),
        F.coalesce(
            F.bool_and(F.when(F.col("_has_path"), F.col("second_section") == HOME)), F.lit(True)
        ).alias("second_all_home"),
        F.min(home).alias("home"),
        F.max(F.struct(*url_order())).getField("url").alias("last_url"),
    )


def site_headers(facts: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site, base_url, name, description) from the homepage, else from the host name.

    ``sites`` brings the base URL each site was given.  A site without pages has no
    header and so no products.
    """
    if sites is None:
        base = facts.withColumn("base_url", F.concat(F.lit("https://"), F.col("site")))
    else:
        base = sites.select("site", "base_url").join(facts, "site")
    return base.select(
        "site",
        "base_url",
        first_non_empty(F.col("home.title"), site_display_name(F.col("site"))).alias("name"),
        F.coalesce(F.col("home.description"), F.lit("")).alias("description"),
    )


def index_section(
    section: Column, second_section: Column, all_home: Column, second_all_home: Column
) -> Column:
    """Section used in the index: flat sites regroup by second segment or lose it."""
    return F.when(~all_home, section).otherwise(
        F.when(second_all_home & (second_section == HOME), F.lit("")).otherwise(second_section)
    )


def pick_description(description: Column, generic: Column, fallback: Column) -> Column:
    """Own description unless it is empty or generic."""
    is_generic = F.coalesce(F.array_contains(generic, description), F.lit(False))
    return F.when((description == "") | is_generic, fallback).otherwise(description)


def describe_pages(pages: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Add ``index_section``, ``index_description`` and ``is_last`` to extracted pages.

    The regrouped sections do not change the description counts, so one join per page
    row brings both; hot sites are salted in it.
    """
    pages = with_second_section(pages)
    facts = site_facts(pages) if facts is None else facts
    generic = (
        generic_descriptions(pages, facts)
        .groupBy("site")
        .agg(F.collect_list("description").alias("generic"))
    )
    per_site = facts.select("site", "all_home", "second_all_home", "last_url").join(generic, "site", "left")
    counts = facts.select("site", F.col("n_pages").alias("n_rows"))
    joined = spread_join(pages, per_site, "site", "url", counts)
    sectioned = index_section(
        F.col("section"), F.col("second_section"), F.col("all_home"), F.col("second_all_home")
    )
    picked = pick_description(
        F.col("description"), F.col("generic"), F.col("fallback_description")
    )
    added = {
        "index_section": sectioned,
        "index_description": picked,
        "is_last": F.col("url") == F.col("last_url"),
    }
    return joined.withColumns(added).drop(
        "second_section", "_below_root", "_has_path", "_is_home", "all_home", "second_all_home",
        "last_url", "generic",
    )
