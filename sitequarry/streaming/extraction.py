"""Extraction of pages as they arrive.

Every step from a captured page to a readable one looks at that page alone, so the batch
expressions run on a stream unchanged and need no state.  What compares pages with one
another (duplicates, sections of flat sites, generic descriptions) stays in batch jobs
over the table written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sitequarry.functions.urls import normalize_url
from sitequarry.operators.computed import with_computed
from sitequarry.operators.extract import DEFAULT_MIN_CONTENT, extract
from sitequarry.operators.lineage import checkpoint_root


def extract_stream(pages: DataFrame, min_content: int = DEFAULT_MIN_CONTENT) -> DataFrame:
    """Outcome rows of a stream of (…, site, url, html); a row without an http(s) URL has that as its
    ``skip_reason`` and keeps the URL as captured."""
    named = with_computed(
        pages.withColumn("captured_url", F.col("url")), {"_normal": normalize_url(F.col("url"))}
    )
    readable = named.withColumns(
        {
            "url": F.coalesce("_normal", "url"),
            "html": F.when(F.col("_normal").isNotNull(), F.col("html")),
        }
    )
    reason = F.when(F.col("_normal").isNull(), F.lit("invalid url")).otherwise(F.col("skip_reason"))
    return extract(readable, min_content).withColumn("skip_reason", reason).drop("_normal")


def start_extraction(
    pages: DataFrame, path: str, name: str, min_content: int = DEFAULT_MIN_CONTENT
) -> StreamingQuery:
    """Append the outcomes of all pages available now to the Parquet table at ``path``.

    Progress is kept in the session's checkpoint folder under ``name``, so the next call
    goes on where this one ended.
    """
    root = checkpoint_root(pages.sparkSession)
    return (
        extract_stream(pages, min_content)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{root}/streams/{name}")
        .trigger(availableNow=True)
        .start()
    )
