"""Extraction: parsed pages to readable pages, or to the reason they were dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.sections import section_of_path
from sitequarry.functions.text import collapse_spaces, first_non_empty, first_sentence, trim_all
from sitequarry.functions.urls import page_segments, path_as_written
from sitequarry.operators.computed import with_computed
from sitequarry.operators.content import blocks_to_markdown, content_blocks
from sitequarry.operators.parse import parse_pages

DEFAULT_MIN_CONTENT = 50
EXTRACTED = ["url", "title", "description", "fallback_description", "markdown", "section"]


def metadata_title() -> Column:
    """``og:title``, else the first h1, else ``<title>``, else empty."""
    return trim_all(first_non_empty(F.col("og_title"), F.col("h1_text"), F.col("title_tag")))


def metadata_description() -> Column:
    """``meta description``, else ``og:description``, else empty."""
    return trim_all(first_non_empty(F.col("meta_desc"), F.col("og_desc")))


def final_title(meta_title: Column) -> Column:
    """``og:title``, else ``<title>`` with spaces collapsed, else the metadata title (X11)."""
    return first_non_empty(
        trim_all(F.col("og_title")), collapse_spaces(F.col("title_tag")), meta_title
    )


def skip_reason(min_content: Column, max_html_chars: int | None = None) -> Column:
    """First failing test of the extraction stage, or NULL."""
    limit = F.lit(max_html_chars).cast("long")
    return (
        F.when(F.col("html_chars").isNull(), F.lit("no html"))
        .when(F.col("html_chars") > limit, F.lit("html too large"))
        .when(F.col("parse_error").isNotNull(), F.lit("parse error"))
        .when(F.col("has_refresh"), F.lit("meta refresh"))
        .when(F.col("meta_title").rlike("(?i)redirect"), F.lit("redirect title"))
        .when(
            (F.col("meta_title") == "") & (F.col("description") == ""),
            F.lit("no title or description"),
        )
        .when(F.col("body_chars") < min_content, F.lit("short body"))
        .when(F.size("content") == 0, F.lit("no main content"))
        .when(F.col("markdown") == "", F.lit("empty markdown"))
        .when(F.length("markdown") < min_content, F.lit("short markdown"))
    )


def parse_for_extraction(
    pages: DataFrame, want_blocks: bool = True, max_html_chars: int | None = None
) -> DataFrame:
    """Parse (…, url, html), keeping the page size next to the parsed fields."""
    sized = pages.withColumn("html_chars", F.length("html"))
    return parse_pages(sized, want_blocks, max_html_chars)


def extract_parsed(
    parsed: DataFrame,
    min_content: str | int = DEFAULT_MIN_CONTENT,
    max_html_chars: int | None = None,
) -> DataFrame:
    """One row per parsed page with the extracted fields and ``skip_reason``.

    ``min_content`` is a number or the name of an integer column; ``max_html_chars`` is the
    limit the pages were parsed with.
    """
    limit = F.col(min_content) if isinstance(min_content, str) else F.lit(min_content)
    added = ["has_refresh", "og_title", "h1_text", "title_tag", "meta_desc", "og_desc"]
    added += ["body_chars", "hrefs", "blocks", "parse_error", "meta_title", "content", "url"]
    carried = [c for c in parsed.columns if c not in added]
    first = {
        "meta_title": metadata_title(),
        "description": metadata_description(),
        "content": content_blocks(F.col("blocks")),
    }
    markdown = F.coalesce(blocks_to_markdown(F.col("content")), F.lit(""))
    return (
        with_computed(with_computed(parsed, first), {"markdown": markdown})
        .withColumn("skip_reason", skip_reason(limit, max_html_chars))
        .select(
            *carried,
            "url",
            final_title(F.col("meta_title")).alias("title"),
            "description",
            first_sentence(F.col("markdown")).alias("fallback_description"),
            "markdown",
            section_of_path(page_segments(path_as_written(F.col("url")))).alias("section"),
            "skip_reason",
        )
    )


def extract(
    pages: DataFrame,
    min_content: str | int = DEFAULT_MIN_CONTENT,
    max_html_chars: int | None = None,
) -> DataFrame:
    """Parse and extract (…, url, html) in one narrow pass."""
    parsed = parse_for_extraction(pages, max_html_chars=max_html_chars)
    return extract_parsed(parsed, min_content, max_html_chars)


def kept_pages(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("skip_reason").isNull()).drop("skip_reason")


def dropped_pages(outcomes: DataFrame, stage: str = "extraction") -> DataFrame:
    """(site, url, stage, skip_reason) of the pages that were not kept."""
    return outcomes.filter(F.col("skip_reason").isNotNull()).select(
        "site", "url", F.lit(stage).alias("stage"), "skip_reason"
    )
