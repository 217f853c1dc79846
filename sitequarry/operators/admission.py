"""Which URLs may be visited at all (stage A), and first-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.urls import (
    glob_to_regex,
    href,
    normalize_url,
    normalized_parts,
    path_locale,
    strip_locale,
)
from sitequarry.operators.computed import with_computed
from sitequarry.operators.lineage import Workspace
from sitequarry.operators.robots import RULES, robots_allow
from sitequarry.operators.skew import spread_join


#: What identifies a capture.
CAPTURE = ["captured_url", "page_id"]


def globs_allow(path: Column, include_rx: Column, exclude_rx: Column) -> Column:
    """Some include pattern matches, or there is none; and no exclude pattern does."""
    included = (F.size(include_rx) == 0) | F.exists(include_rx, lambda p: F.rlike(path, p))
    return included & ~F.exists(exclude_rx, lambda p: F.rlike(path, p))


def locale_allows(path: Column, lang: Column) -> Column:
    """No language filter, no locale prefix, or the right one."""
    locale = path_locale(path)
    return lang.isNull() | locale.isNull() | (locale == lang)


def claim_key(url: Column, path: Column, lang: Column) -> Column:
    """What a visit claims: the locale-free path under a language filter, else the URL.

    Two URLs with one normal form share their locale-free path, so one key serves both
    rules (F1, F8).
    """
    return F.when(lang.isNull(), url).otherwise(strip_locale(path))


def skip_reason(site: Column, parts: Column, policy: Column | None = None) -> Column:
    """First failing admission test of a normalised URL, or NULL."""
    path = parts["path"]
    get = (lambda name: policy[name]) if policy is not None else F.col
    locale = path_locale(path)
    wrong = F.concat(F.lit("locale "), locale, F.lit(" (want "), get("lang"), F.lit(")"))
    return (
        F.when(parts.isNull(), F.lit("invalid url"))
        .when(~robots_allow(path, get("rules")), F.lit("robots.txt blocked"))
        .when(parts["host"] != site, F.lit("excluded"))
        .when(~globs_allow(path, get("include_rx"), get("exclude_rx")), F.lit("excluded"))
        .when(~locale_allows(path, get("lang")), wrong)
    )


def site_policy(
    sites: DataFrame, rules: DataFrame, languages: DataFrame, escape_globs: bool = False
) -> DataFrame:
    """The sites with ``include_rx``, ``exclude_rx``, ``rules`` and the language to keep.

    ``languages`` is (url, html_lang) of unique pages; the language of the page at the base
    URL is used where a site names none (J9).
    """
    detected = languages.select(
        F.col("url").alias("norm_base"), F.col("html_lang").alias("_detected")
    )
    no_rules = F.array().cast(RULES)
    rx = lambda globs: F.transform(globs, lambda g: glob_to_regex(g, escape_globs))
    return (
        sites.withColumn("norm_base", normalize_url(F.col("base_url")))
        .join(detected, "norm_base", "left")
        .join(rules, "site", "left")
        .select(
            "site",
            "base_url",
            "norm_base",
            "depth",
            "max_pages",
            "max_sitemap_urls",
            "min_content_length",
            F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.col("_detected")).alias("lang"),
            rx(F.col("include")).alias("include_rx"),
            rx(F.col("exclude")).alias("exclude_rx"),
            F.coalesce("rules", no_rules).alias("rules"),
        )
    )


def check_sites(
    sites: DataFrame, workspace: Workspace, escape_globs: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The usable rows of ``complete_sites``, and (site, url, stage, skip_reason) of the others.

    A row is refused for a base URL that is none, a pattern that is no regular expression, or a host
    that another row has; of rows with one host the one with the least base URL stays.
    """

    def invalid(glob: Column) -> Column:
        # Reflection gives NULL where the compiler throws.
        compiled = F.try_reflect(
            F.lit("java.util.regex.Pattern"), F.lit("compile"), glob_to_regex(glob, escape_globs)
        )
        return compiled.isNull()

    reason = F.when(normalize_url(F.col("base_url")).isNull(), F.lit("invalid url")).when(
        F.exists("include", invalid) | F.exists("exclude", invalid), F.lit("invalid pattern")
    )
    place = Window.partitionBy("site", "_reason").orderBy("base_url")
    marked = workspace.table(
        sites.withColumn("_reason", reason)
        .withColumn("_place", F.row_number().over(place))
        .withColumn(
            "_reason",
            F.when(F.col("_reason").isNull() & (F.col("_place") > 1), F.lit("duplicate site"))
            .otherwise(F.col("_reason")),
        ),
        "sites",
    )
    good = marked.filter("_reason IS NULL").select(*sites.columns)
    refused = marked.filter("_reason IS NOT NULL").select(
        "site",
        F.col("base_url").alias("url"),
        F.lit("site").alias("stage"),
        F.col("_reason").alias("skip_reason"),
    )
    return good, refused


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key; ranking is limited map-side, so hot groups of copies stay cheap."""
    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(place)).filter("_place = 1").drop("_place")


def identify_pages(pages: DataFrame) -> DataFrame:
    """Replace ``url`` by its normal form and keep the captured one as ``captured_url`` (U4).

    Rows without an http(s) URL are left out; ``invalid_urls`` reports them.
    """
    kept = pages.withColumn("captured_url", F.col("url"))
    return with_computed(kept, {"url": normalize_url(F.col("url"))}).filter("url IS NOT NULL")


def unique_pages(pages: DataFrame) -> DataFrame:
    """One captured page per URL of ``identify_pages``.

    A capture made at the normal form itself wins, then the least captured URL.
    """
    order = ["_differs", "captured_url"] + (["page_id"] if "page_id" in pages.columns else [])
    marked = pages.withColumn("_differs", F.col("captured_url") != F.col("url"))
    return first_by(marked, ["url"], order).drop("_differs")


def one_capture(pages: DataFrame, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    """One row per URL of ``identify_pages``, the one ``unique_pages`` picks, and the others as
    dropped rows (site, url, stage, skip_reason).

    Works on keys alone, so that page content need not be shuffled to find the few
    captures to skip; URL and ``page_id`` identify a capture.  URLs with very many captures are
    combined map-side and salted.  A capture that is there more than once is reduced to one row, or
    its copies would multiply in every join by URL; only such rows are shuffled with their content.
    """
    keys = pages.select("site", "url", "captured_url", "page_id")
    rank = F.struct(F.col("captured_url") != F.col("url"), "captured_url", "page_id")
    repeated = workspace.table(
        keys.groupBy("url")
        .agg(F.min(rank).alias("_winner"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("_winner", F.struct("_winner.captured_url", "_winner.page_id"))
        .filter("n_rows > 1"),
        "repeated-urls",
    )
    joined = spread_join(
        keys, repeated.drop("n_rows"), "url", "page_id", repeated.select("url", "n_rows"), "inner"
    )
    # A row per capture and not per copy: few rows however often a table was repeated.
    captures = workspace.table(
        joined.groupBy(*keys.columns)
        .agg(
            F.any_value(
                F.struct("captured_url", "page_id").eqNullSafe(F.col("_winner"))
            ).alias("wins"),
            F.count(F.lit(1)).alias("n_copies"),
        ),
        "repeated-captures",
    )
    n_dropped = F.col("n_copies") - F.col("wins").cast("int")
    dropped = captures.filter(n_dropped > 0).select(
        "site",
        F.col("captured_url").alias("url"),
        F.lit("admission").alias("stage"),
        F.lit("duplicate").alias("skip_reason"),
        F.explode(F.sequence(F.lit(1).cast("long"), n_dropped)).alias("_copy"),
    ).drop("_copy")
    left = pages.join(*_same_capture(pages, captures.filter("not wins")), "left_anti")
    copied = captures.filter("wins and n_copies > 1")
    if copied.isEmpty():
        return left, dropped
    single = left.join(*_same_capture(left, copied), "left_anti")
    several = left.join(*_same_capture(left, copied), "left_semi")
    rest = [c for c in pages.columns if c not in CAPTURE]
    merged = several.groupBy(*CAPTURE).agg(F.min(F.struct(*rest)).alias("_row"))
    one = merged.select(*CAPTURE, "_row.*").select(*pages.columns)
    return single.unionByName(one), dropped


def _same_capture(pages: DataFrame, captures: DataFrame) -> tuple[DataFrame, Column]:
    """``captures`` under names of its own, and the condition that joins it; a NULL ``page_id`` is one."""
    named = captures.select(*[F.col(c).alias(f"_{c}") for c in CAPTURE])
    url, page_id = (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in CAPTURE)
    return named, url & page_id


def invalid_urls(pages: DataFrame) -> DataFrame:
    """Rows whose URL is no http(s) URL, as dropped rows."""
    return pages.filter(normalize_url(F.col("url")).isNull()).select(
        F.lit(None).cast("string").alias("site"),
        "url",
        F.lit("admission").alias("stage"),
        F.lit("invalid url").alias("skip_reason"),
    )


def check_urls(pages: DataFrame) -> DataFrame:
    """Add ``norm_url``, ``claim`` and ``skip_reason`` to pages that carry their site's policy."""
    path = F.col("_parts")["path"]
    columns = {
        "norm_url": href(F.col("_parts")),
        "skip_reason": skip_reason(F.col("site"), F.col("_parts")),
        "claim": claim_key(href(F.col("_parts")), path, F.col("lang")),
    }
    parsed = with_computed(pages, {"_parts": normalized_parts(F.col("url"))})
    return parsed.withColumns(columns).drop("_parts")
