"""The three products and the summary of a site, as ordered rows of text.

A product is a table of text rows with sort columns.  Written in that order it is the
document, byte for byte; no document has to fit into one row, task or process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.sections import section_rank
from sitequarry.operators.describe import url_order
from sitequarry.operators.lineage import Workspace
from sitequarry.operators.skew import number_rows, spread_join

LINES_PER_CHUNK = 10_000


def index_line(title: Column, url: Column, description: Column) -> Column:
    """``- [title](url)`` with ``: description`` when there is one."""
    suffix = F.when(description == "", F.lit("")).otherwise(F.concat(F.lit(": "), description))
    return F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")"), suffix)


def index_rows(described: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows (site, part, section_rank, section, kind, url, line) of the site indexes (K1)."""
    empty = F.lit("")
    name = headers.select(
        "site",
        F.lit(0).alias("part"),
        F.lit(0).alias("section_rank"),
        empty.alias("section"),
        F.lit(0).alias("kind"),
        empty.alias("url"),
        F.concat(F.lit("# "), F.col("name")).alias("line"),
    )
    summary = headers.filter(F.col("description") != "").select(
        "site",
        F.lit(1).alias("part"),
        F.lit(0).alias("section_rank"),
        empty.alias("section"),
        F.lit(0).alias("kind"),
        empty.alias("url"),
        F.concat(F.lit("\n> "), F.col("description")).alias("line"),
    )
    section = F.col("section")
    titles = (
        described.select("site", F.col("index_section").alias("section"))
        .distinct()
        .select(
            "site",
            F.lit(2).alias("part"),
            section_rank(section).alias("section_rank"),
            "section",
            F.lit(0).alias("kind"),
            empty.alias("url"),
            F.when(section == "", empty)
            .otherwise(F.concat(F.lit("\n## "), section, F.lit("\n")))
            .alias("line"),
        )
    )
    lines = described.select(
        "site",
        F.lit(2).alias("part"),
        section_rank(F.col("index_section")).alias("section_rank"),
        F.col("index_section").alias("section"),
        F.lit(1).alias("kind"),
        "url",
        index_line(F.col("title"), F.col("url"), F.col("index_description")).alias("line"),
    )
    return name.unionByName(summary).unionByName(titles).unionByName(lines)


def index_order() -> list[Column]:
    """Sort key of index rows within a site (O1, O2)."""
    return [
        F.col("part"),
        F.col("section_rank"),
        F.collate("section", "UNICODE"),
        F.col("section"),
        F.col("kind"),
        *url_order(),
    ]


def index_documents(
    rows: DataFrame, workspace: Workspace, lines_per_chunk: int = LINES_PER_CHUNK
) -> DataFrame:
    """(site, chunk, n_lines, text): the index as text, one row per site.

    A site with more lines than ``lines_per_chunk`` has several chunks; put together in
    order they are the document.
    """
    numbered = number_rows(rows.select(
        "site", "part", "section_rank", "section", "kind", "url", "line"
    ), "site", index_order(), workspace)
    return (
        numbered.withColumn(
            "chunk", F.floor((F.col("position") - 1) / lines_per_chunk).cast("int")
        )
        .groupBy("site", "chunk")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.expr(r"listagg(line, '\n') WITHIN GROUP (ORDER BY position) || '\n'").alias("text"),
        )
    )


def full_rows(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows (site, part, url, text) of the full bundles: header, then pages by URL (K2)."""
    quote = F.when(F.col("description") == "", F.lit("")).otherwise(
        F.concat(F.lit("\n\n> "), F.col("description"))
    )
    head = headers.select(
        "site",
        F.lit(0).alias("part"),
        F.lit("").alias("url"),
        F.concat(F.lit("# "), F.col("name"), quote).alias("text"),
    )
    body = pages.select(
        "site",
        F.lit(1).alias("part"),
        "url",
        F.concat(
            F.lit("\n---\n\n## "),
            F.col("title"),
            F.lit("\n\nSource: "),
            F.col("url"),
            F.lit("\n\n"),
            F.col("markdown"),
        ).alias("text"),
    )
    return head.unionByName(body)


def full_order() -> list[Column]:
    return [F.col("part"), *url_order()]


def listing_rows(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """One row per page of the JSON listing, with the fields of its site (K3).

    The section is the one of the page, before regrouping; the description is the raw one.
    """
    head = headers.select(
        "site", "name", F.col("description").alias("site_description"), "base_url"
    )
    fields = pages.select("site", "url", "title", "description", "section")
    return spread_join(fields, head, "site", "url", how="inner")


def _json_string(value: Column) -> Column:
    """``value`` as a JSON string literal."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def json_rows(described: DataFrame, headers: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (site, part, url, text) of the JSON listings, indented by two spaces (K3)."""
    counted = headers.join(facts.select("site", "n_pages"), "site", "left")
    has_pages = F.coalesce(F.col("n_pages"), F.lit(0)) > 0
    head = counted.select(
        "site",
        F.lit(0).alias("part"),
        F.lit("").alias("url"),
        F.concat(
            F.lit('{\n  "name": '),
            _json_string(F.col("name")),
            F.lit(',\n  "description": '),
            _json_string(F.col("description")),
            F.lit(',\n  "url": '),
            _json_string(F.col("base_url")),
            F.when(has_pages, F.lit(',\n  "pages": [')).otherwise(F.lit(',\n  "pages": []\n}')),
        ).alias("text"),
    )
    foot = counted.filter(has_pages).select(
        "site", F.lit(2).alias("part"), F.lit("").alias("url"), F.lit("  ]\n}").alias("text")
    )
    fields = [F.lit("    {")]
    for n, field in enumerate(("url", "title", "description", "section")):
        fields += [F.lit(f'{"," if n else ""}\n      "{field}": '), _json_string(F.col(field))]
    fields.append(F.when(F.col("is_last"), F.lit("\n    }")).otherwise(F.lit("\n    },")))
    body = described.select(
        "site", F.lit(1).alias("part"), "url", F.concat(*fields).alias("text")
    )
    return head.unionByName(body).unionByName(foot)


def site_summary(pages: DataFrame, rows: DataFrame, text: str = "line") -> DataFrame:
    """(site, n_pages, n_sections, size_kb): what a run reports per site (K4, A5).

    ``rows`` are the text rows of the product whose size is reported.
    """
    counts = pages.groupBy("site", "section").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.groupBy("site").agg(
        F.sum("_n").alias("n_pages"), F.count(F.lit(1)).alias("n_sections")
    )
    size = rows.groupBy("site").agg(F.sum(F.octet_length(text) + 1).alias("_bytes"))
    return counts.join(size, "site").select(
        "site", "n_pages", "n_sections", F.round(F.col("_bytes") / 1024, 1).alias("size_kb")
    )


def size_reduction(pages: DataFrame) -> DataFrame:
    """(site, html_chars, markdown_chars, reduction) of pages with ``html_chars``."""
    sums = pages.groupBy("site").agg(
        F.sum("html_chars").alias("html_chars"),
        F.sum(F.length("markdown")).alias("markdown_chars"),
    )
    return sums.withColumn("reduction", 1 - F.col("markdown_chars") / F.col("html_chars"))
