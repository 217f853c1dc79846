"""The jobs a user runs: captured pages in, site products out."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitequarry.functions.text import html_language
from sitequarry.functions.urls import normalize_url
from sitequarry.operators.admission import (
    check_sites,
    identify_pages,
    invalid_urls,
    one_capture,
    site_policy,
)
from sitequarry.operators.assemble import (
    full_order,
    full_rows,
    index_order,
    index_rows,
    json_rows,
    site_summary,
)
from sitequarry.operators.describe import (
    describe_pages,
    site_facts,
    site_headers,
    with_second_section,
)
from sitequarry.operators.extract import (
    DEFAULT_MIN_CONTENT,
    dropped_pages,
    extract,
    extract_parsed,
    kept_pages,
    parse_for_extraction,
)
from sitequarry.operators.lineage import Workspace
from sitequarry.operators.reach import cap_visits, page_links, reach
from sitequarry.operators.responses import (
    classify_responses,
    pages_from_fetches,
    refused_fetches,
)
from sitequarry.operators.robots import (
    robots_directives,
    robots_rules,
    site_rules,
    sitemap_locations,
)
from sitequarry.operators.sitemaps import (
    cap_sitemap_urls,
    classify_sitemap_urls,
    sitemap_closure,
)
from sitequarry.sinks.products import chosen_products, write_document_table, write_documents


class SiteProducts:
    """Tables of one run.  ``pages`` and ``dropped`` together hold every URL considered.

    What the index and the listing share is written once, without the page content, the
    first time it is asked for.
    """

    def __init__(
        self,
        pages: DataFrame,
        dropped: DataFrame,
        fetched: DataFrame,
        workspace: Workspace,
        sites: DataFrame | None = None,
    ):
        self.pages, self.dropped, self.fetched = pages, dropped, fetched
        self.workspace, self.sites = workspace, sites

    @cached_property
    def facts(self) -> DataFrame:
        """What is known per site; see ``site_facts``."""
        narrow = with_second_section(self.pages.drop("markdown"))
        return self.workspace.table(site_facts(narrow), "facts")

    @cached_property
    def headers(self) -> DataFrame:
        return site_headers(self.facts, self.sites)

    @cached_property
    def described(self) -> DataFrame:
        """Pages with the section and description they have in the index."""
        narrow = self.pages.select(
            "site", "url", "title", "description", "fallback_description", "section"
        )
        return self.workspace.table(describe_pages(narrow, self.facts), "described")

    def index(self) -> DataFrame:
        return index_rows(self.described, self.headers)

    def full(self) -> DataFrame:
        return full_rows(self.pages, self.headers)

    def json(self) -> DataFrame:
        return json_rows(self.described, self.headers, self.facts)

    def summary(self) -> DataFrame:
        return site_summary(self.pages, self.index())

    def empty_sites(self) -> DataFrame:
        """Listed sites none of whose pages could be extracted; they get no products."""
        return self.sites.select("site", "base_url").join(self.facts, "site", "left_anti")

    def skip_counts(self) -> DataFrame:
        """(site, stage, skip_reason, n_pages) of all dropped pages."""
        return self.dropped.groupBy("site", "stage", "skip_reason").agg(
            F.count(F.lit(1)).alias("n_pages")
        )

    def run_counts(self) -> DataFrame:
        """(site, n_fetched, n_skipped, n_extracted), the verbose summary (K6)."""
        parts = [("n_fetched", self.fetched), ("n_skipped", self.dropped), ("n_extracted", self.pages)]
        rows = None
        for name, df in parts:
            counted = df.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
            counted = counted.select("site", F.lit(name).alias("what"), "n")
            rows = counted if rows is None else rows.unionByName(counted)
        sums = [
            F.coalesce(F.sum(F.when(F.col("what") == n, F.col("n"))), F.lit(0)).alias(n)
            for n, _ in parts
        ]
        return rows.groupBy("site").agg(*sums)

    def write(
        self, path: str, full: bool = False, json: bool = False, by_site: bool = True
    ) -> None:
        """Write the chosen products: as text, one folder per site, or each as one table of lines,
        which is the form for very many sites (K5)."""
        write = write_documents if by_site else write_document_table
        for product in chosen_products(full, json):
            if product == "index":
                write(self.index(), index_order(), "line", f"{path}/index")
            elif product == "full":
                write(self.full(), full_order(), "text", f"{path}/full")
            else:
                write(self.json(), full_order(), "text", f"{path}/json")


def index_captured_pages(
    pages: DataFrame,
    workspace: Workspace,
    min_content: int = DEFAULT_MIN_CONTENT,
    max_html_chars: int | None = None,
) -> SiteProducts:
    """Products of every site among ``pages`` (page_id, site, url, html), from all its pages.

    Repeated captures go before the parse.  Parsing and extraction are one narrow pass: content is not
    shuffled while the repeated captures fit a broadcast, which Spark decides by the size of their table.
    """
    identified = identify_pages(pages)
    captures, duplicates = one_capture(identified, workspace)
    found = workspace.table(extract(captures, min_content, max_html_chars), "outcomes")
    dropped = (
        dropped_pages(found)
        .unionByName(duplicates)
        .unionByName(invalid_urls(pages))
    )
    return SiteProducts(kept_pages(found), dropped, found, workspace)


@dataclass
class Discovery:
    """What following the rules of each site led to."""

    parsed: DataFrame  # captured pages, parsed, one per URL
    fetched: DataFrame  # (site, url, depth, wave, path_pos, …) of the pages to use
    dropped: DataFrame  # (site, url, stage, skip_reason) of everything refused or missing


def discover(
    sites: DataFrame,
    pages: DataFrame,
    robots: DataFrame,
    sitemaps: DataFrame,
    workspace: Workspace,
    escape_globs: bool = False,
    want_blocks: bool = True,
    max_html_chars: int | None = None,
    refused_responses: DataFrame | None = None,
) -> Discovery:
    """Follow robots rules, sitemaps and links from the base page of each site.

    Only pages of listed sites are looked at, and each URL is parsed once.  Without ``want_blocks``
    the pages are parsed for their links only.  ``refused_responses`` (url, skip_reason) says why
    there is no page for a URL.
    """
    sites, refused_sites = check_sites(sites, workspace, escape_globs)
    asked = pages.join(sites.select("site"), "site", "left_semi")
    found = identify_pages(asked).withColumn("html_lang", html_language(F.col("html")))
    captures, duplicates = one_capture(found, workspace)
    parsed = workspace.keyed_table(
        parse_for_extraction(captures, want_blocks, max_html_chars), "parsed", "url"
    )
    directives = workspace.table(robots_directives(robots), "robots")
    rules = site_rules(robots_rules(directives))
    policy = workspace.table(
        site_policy(sites, rules, parsed.select("url", "html_lang"), escape_globs), "policy"
    )
    listed = sitemap_closure(sitemap_locations(sites, directives), sitemaps, workspace)
    checked = workspace.table(classify_sitemap_urls(listed, policy), "sitemap-urls")
    links = workspace.keyed_table(page_links(parsed, policy), "links", "url")
    seeds, unread = cap_sitemap_urls(checked, policy, workspace)
    visits, refused = reach(policy, seeds, links, workspace)
    captured = parsed.select("url")
    fetched = workspace.table(
        visits.drop("claim", "max_depth").join(captured, "url"), "fetched"
    )
    unlisted = checked.filter("skip_reason IS NOT NULL").select(
        "site", "url", F.lit("sitemap").alias("stage"), "skip_reason"
    )
    missing = visits.join(captured, "url", "left_anti").select("site", "url")
    reason = F.lit("non-HTML or failed")
    if refused_responses is not None:
        known = refused_responses.select(
            normalize_url(F.col("url")).alias("url"), F.col("skip_reason").alias("_why")
        )
        known = known.groupBy("url").agg(F.min("_why").alias("_why"))
        missing, reason = missing.join(known, "url", "left"), F.coalesce("_why", reason)
    missing = missing.select(
        "site", "url", F.lit("response").alias("stage"), reason.alias("skip_reason")
    )
    within, beyond = cap_visits(fetched, workspace)

    def cut(rows: DataFrame, stage: str, why: str) -> DataFrame:
        return rows.select(
            "site", "url", F.lit(stage).alias("stage"), F.lit(why).alias("skip_reason")
        )

    dropped = (
        refused.unionByName(unlisted)
        .unionByName(missing)
        .unionByName(refused_sites)
        .unionByName(duplicates)
        .unionByName(cut(unread, "sitemap", "over the sitemap limit"))
        .unionByName(cut(beyond, "response", "over the page limit"))
    )
    return Discovery(parsed, within, dropped)


def build_site_index(
    sites: DataFrame,
    pages: DataFrame,
    robots: DataFrame,
    sitemaps: DataFrame,
    workspace: Workspace,
    escape_globs: bool = False,
    max_html_chars: int | None = None,
    refused_responses: DataFrame | None = None,
) -> SiteProducts:
    """Products of the listed sites from the pages they reach.

    ``sites`` comes from ``complete_sites``; ``robots`` is (site, status, body), ``sitemaps``
    (sitemap_url, status, xml), ``pages`` (page_id, site, url, html).
    """
    found = discover(
        sites,
        pages,
        robots,
        sitemaps,
        workspace,
        escape_globs,
        max_html_chars=max_html_chars,
        refused_responses=refused_responses,
    )
    reached = found.fetched.join(found.parsed.drop("site"), "url")
    extracted = extract_parsed(reached, "min_content_length", max_html_chars)
    outcomes = workspace.table(extracted, "outcomes")
    dropped = dropped_pages(outcomes).unionByName(found.dropped)
    return SiteProducts(kept_pages(outcomes), dropped, outcomes, workspace, sites)


def index_fetched_sites(
    sites: DataFrame,
    fetches: DataFrame,
    robots: DataFrame,
    sitemaps: DataFrame,
    workspace: Workspace,
    escape_globs: bool = False,
    max_attempts: int | None = None,
    max_body_bytes: int | None = None,
    max_html_chars: int | None = None,
) -> SiteProducts:
    """``build_site_index`` over recorded fetch attempts (url, attempt, status, content_type,
    content_length, body) instead of pages; a visit without a page gets the reason of its response.
    """
    settled = workspace.table(
        classify_responses(fetches, max_attempts, max_body_bytes), "responses"
    )
    return build_site_index(
        sites,
        pages_from_fetches(settled),
        robots,
        sitemaps,
        workspace,
        escape_globs,
        max_html_chars,
        refused_fetches(settled),
    )
