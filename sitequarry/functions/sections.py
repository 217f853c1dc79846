"""Section names derived from URL paths, and their order."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitequarry.functions.text import title_case
from sitequarry.functions.urls import bind

HOME = "Home"
BLOG = "Blog"

# First path segment and the section it stands for.
SECTION_BY_SEGMENT = {
    "docs": "Documentation",
    "documentation": "Documentation",
    "doc": "Documentation",
    "blog": "Blog",
    "posts": "Blog",
    "articles": "Blog",
    "news": "Blog",
    "api": "API Reference",
    "reference": "API Reference",
    "guide": "Guides",
    "guides": "Guides",
    "tutorial": "Guides",
    "tutorials": "Guides",
    "changelog": "Changelog",
    "releases": "Changelog",
    "faq": "FAQ",
    "about": "About",
    "team": "About",
    "contact": "About",
}

# Section and its rank in an index; other sections get DEFAULT_RANK.
RANK_BY_SECTION = {
    "Home": 100,
    "Documentation": 200,
    "Guides": 210,
    "API Reference": 300,
    "Blog": 400,
    "Changelog": 450,
    "FAQ": 460,
    "About": 900,
}
DEFAULT_RANK = 500


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(values.items())])


def section_of_segment(segment: Column) -> Column:
    """Section named by one path segment: year, known prefix, or the segment itself."""

    def named(low: Column) -> Column:
        return F.when(low.rlike("^20[0-9]{2}$"), F.lit(BLOG)).otherwise(
            F.try_element_at(_literal_map(SECTION_BY_SEGMENT), low)
        )

    return F.coalesce(bind(F.lower(segment), named), title_case(segment))


def section_of_path(segments: Column) -> Column:
    """Section of a page from its path segments; top-level pages are Home."""
    return F.when(F.size(segments) <= 1, F.lit(HOME)).otherwise(
        section_of_segment(F.get(segments, F.lit(0)))
    )


def section_rank(section: Column) -> Column:
    """Sort key of a section."""
    return F.coalesce(F.try_element_at(_literal_map(RANK_BY_SECTION), section), F.lit(DEFAULT_RANK))
