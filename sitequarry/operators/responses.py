"""From recorded fetch attempts to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.urls import hostname

# Statuses worth another attempt.
RETRYABLE_STATUS = [429, 500, 502, 503, 504]
# Leading characters of PDF, PNG, GIF, JPEG and ZIP bodies.
BINARY_SIGNATURES = ["%PDF", "\x89PNG", "GIF8", "\xff\xd8\xff", "PK"]


def is_retryable(status: Column) -> Column:
    """A request that failed has no status; it is worth another attempt too."""
    return F.coalesce(status.isin(RETRYABLE_STATUS), F.lit(True))


def final_attempts(fetches: DataFrame, max_attempts: int | None = None) -> DataFrame:
    """The attempt that settles each URL: the first not worth retrying, else the last.

    ``max_attempts`` leaves later attempts out.  Only bodies that can become pages travel through
    the shuffle, and the ranking is limited map-side, so a URL with very many rows is no hot spot.
    """
    useful = F.col("status").between(200, 299)
    sized = fetches.withColumn("body_bytes", F.octet_length("body"))
    return _settling(sized.withColumn("body", F.when(useful, F.col("body"))), max_attempts)


def _settling(fetches: DataFrame, max_attempts: int | None) -> DataFrame:
    again = is_retryable(F.col("status"))
    order = Window.partitionBy("url").orderBy(
        again, F.when(again, -F.col("attempt")).otherwise(F.col("attempt"))
    )
    counted = F.lit(True) if max_attempts is None else F.col("attempt") <= max_attempts
    return (
        fetches.filter(counted)
        .withColumn("_rank", F.row_number().over(order))
        .filter("_rank = 1")
        .drop("_rank")
    )


def looks_binary(body: Column) -> Column:
    """The text starts like a binary file."""
    head = F.left(body, F.lit(8))
    found = F.lit(False)
    for signature in BINARY_SIGNATURES:
        found = found | F.startswith(head, F.lit(signature))
    return found


def response_skip_reason(max_body_bytes: int | None = None) -> Column:
    """First failing response test, or NULL; a NULL status stands for a failed request.

    Without ``max_body_bytes`` no size is too large.
    """
    content_type = F.coalesce(F.col("content_type"), F.lit(""))
    limit = F.lit(max_body_bytes).cast("long")
    return (
        F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.lit("bad status"))
        .when(~F.contains(content_type, F.lit("text/html")), F.lit("not html"))
        .when(F.col("content_length") > limit, F.lit("declared too large"))
        .when(F.col("body_bytes") > limit, F.lit("body too large"))
        .when(looks_binary(F.col("body")), F.lit("binary content"))
        .when(F.coalesce(F.col("body"), F.lit("")) == "", F.lit("empty body"))
    )


def classify_responses(
    fetches: DataFrame, max_attempts: int | None = None, max_body_bytes: int | None = None
) -> DataFrame:
    """One row per URL with ``skip_reason``; rows without one are pages, and only they keep a body.

    Each attempt is judged where it is read: a body that is refused is neither sorted nor shuffled.
    """
    sized = fetches.withColumn("body_bytes", F.octet_length("body"))
    judged = sized.withColumn("skip_reason", response_skip_reason(max_body_bytes))
    kept = F.when(F.col("skip_reason").isNull(), F.col("body"))
    return _settling(judged.withColumn("body", kept), max_attempts)


def pages_from_fetches(classified: DataFrame) -> DataFrame:
    """(page_id, site, url, html) of the rows of ``classify_responses`` that hold a page."""
    return classified.filter(F.col("skip_reason").isNull()).select(
        F.xxhash64("url").alias("page_id"),
        hostname(F.col("url")).alias("site"),
        "url",
        F.col("body").alias("html"),
    )


def refused_fetches(classified: DataFrame) -> DataFrame:
    """(site, url, stage, skip_reason) of the rows of ``classify_responses`` that hold none."""
    return classified.filter(F.col("skip_reason").isNotNull()).select(
        hostname(F.col("url")).alias("site"), "url", F.lit("response").alias("stage"), "skip_reason"
    )
