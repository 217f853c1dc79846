"""One query per operator, over the given tables or data derived from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions import sections, text, urls
from sitequarry.operators import (
    admission,
    assemble,
    content,
    describe,
    extract,
    reach,
    responses,
    robots,
    sitemaps,
)
from sitequarry.operators.lineage import Workspace
from sitequarry.operators.parse import parse_pages
from sitequarry.operators.robots_index import robots_indexed as indexed_robots
from sitequarry.operators.skew import spread_join
from sitequarry.plans import derived, site_index
from sitequarry.sources import tables

# Limits that queries pass in; the operators have none of their own.
MAX_ATTEMPTS = 3
MAX_BODY_BYTES = 10 * 1024 * 1024
MAX_HTML_CHARS = 5 * 1024 * 1024

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_pages(spark, f"{sf_dir}/pages.parquet")


def _captured(spark: SparkSession, sf_dir: str) -> site_index.SiteProducts:
    return site_index.index_captured_pages(_pages(spark, sf_dir), Workspace(spark))


def _shop_inputs(spark: SparkSession, sf_dir: str, capped: bool = False) -> tuple:
    return (
        tables.complete_sites(derived.shop_sites(spark, sf_dir, capped)),
        derived.shop_pages(spark, sf_dir),
        derived.shop_robots(spark, sf_dir),
        derived.shop_sitemaps(spark, sf_dir),
        Workspace(spark),
    )


# -- URL functions ----------------------------------------------------------------------


@query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.url_variants(spark, sf_dir).select(
        "page_id", "variant", urls.normalize_url(F.col("url")).alias("norm_url")
    )


@query
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = urls.url_parts(F.col("url"))
    return (
        derived.url_variants(spark, sf_dir)
        .select("page_id", "variant", parts.alias("p"))
        .select("page_id", "variant", "p.scheme", "p.host", "p.port", "p.path")
    )


@query
def url_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = urls.path_depth(urls.url_path(F.col("url")))
    return derived.url_variants(spark, sf_dir).select("page_id", "variant", depth.alias("depth"))


@query
def url_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return (
        derived.table(spark, sf_dir, "pages")
        .select("page_id", urls.url_path(F.col("url")).alias("path"))
        .select(
            "page_id",
            urls.path_locale(path).alias("locale"),
            urls.strip_locale(path).alias("canonical"),
        )
    )


@query
def site_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.page_hosts(spark, sf_dir).select(
        "site", urls.site_display_name(F.col("site")).alias("name")
    )


def _written_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs, some without scheme, with another scheme or broken."""
    n = F.col("page_id") % 4
    bare = F.regexp_replace("url", "^https?://", "")
    return derived.table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(n == 0, F.col("url"))
        .when(n == 1, bare)
        .when(n == 2, F.concat(F.lit("ftp://"), bare))
        .otherwise(F.concat(F.lit("not a url "), F.col("page_id").cast("string")))
        .alias("written"),
    )


@query
def default_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written_urls(spark, sf_dir).select(
        "page_id", urls.ensure_scheme(F.col("written")).alias("url")
    )


@query
def url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written_urls(spark, sf_dir).select(
        "page_id", urls.is_valid_url(F.col("written")).alias("valid")
    )


@query
def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = derived.page_hosts(spark, sf_dir)
    given = hosts.select(
        F.col("site").alias("base_url"),
        F.when(F.length("site") % 2 == 0, F.lit(1)).alias("depth"),
        F.when(F.length("site") % 3 == 0, F.lit("FR")).alias("lang"),
    )
    return tables.complete_sites(given).select(
        "site", "base_url", "depth", "max_pages", "lang", "min_content_length",
        F.size("include").alias("n_include"), F.size("exclude").alias("n_exclude"),
    )


# -- HTML and text ------------------------------------------------------------------------


@query
def html_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.html_language(F.col("html")).alias("lang"))


def _parsed(spark: SparkSession, sf_dir: str, want_blocks: bool = False) -> DataFrame:
    return parse_pages(_pages(spark, sf_dir), want_blocks)


@query
def page_meta_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", extract.metadata_title().alias("title"))


@query
def page_final_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = extract.final_title(extract.metadata_title())
    return _parsed(spark, sf_dir).select("page_id", title.alias("title"))


@query
def page_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.customer_pages(spark, sf_dir)
    return extract.extract(pages).select(
        "c_custkey", "title", "description", "markdown", "skip_reason"
    )


@query
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = urls.url_parts(F.col("url"))
    links = reach.resolved_links(F.col("hrefs"), F.col("p"), F.col("site"))
    return (
        _parsed(spark, sf_dir)
        .withColumn("p", page)
        .select("page_id", F.explode(links).alias("link"))
        .select("page_id", "link.pos", urls.href(F.col("link.parts")).alias("target"))
    )


@query
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        page_links(spark, sf_dir)
        .withColumn("site", urls.hostname(F.col("target")))
        .groupBy("site", "target")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("site")
        .agg(F.sum("n").alias("n_links"), F.count(F.lit(1)).alias("n_targets"))
    )


@query
def body_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("page_id", "body_chars")


@query
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = content.content_blocks(F.col("blocks"))
    return (
        _parsed(spark, sf_dir, True)
        .withColumn("kept", kept)
        .select(
            "page_id",
            F.size("kept").alias("n_blocks"),
            F.aggregate("kept", F.lit(0), lambda a, b: a + b["n_words"]).alias("n_words"),
        )
    )


@query
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _parsed(spark, sf_dir, True)
        .withColumn("kept", content.content_blocks(F.col("blocks")))
        .select("page_id", content.blocks_to_markdown(F.col("kept")).alias("markdown"))
    )


@query
def collapse_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.lit("\n\n\t "), F.replace("text", F.lit("\n"), F.lit("\n\n\n\n")), F.lit(" \n"))
    return derived.table(spark, sf_dir, "documents").select(
        "doc_id", text.collapse_blank_lines(spaced).alias("text")
    )


@query
def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "documents").select(
        "doc_id", text.first_sentence(F.col("text")).alias("sentence")
    )


@query
def block_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kept(block, i):
        blocks = F.col("blocks")
        return content.is_content_block(block, F.get(blocks, i - 1), F.get(blocks, i + 1))

    return derived.document_lines(spark, sf_dir).select(
        "doc_id", F.posexplode(F.transform("blocks", kept)).alias("idx", "is_content")
    )


# -- sections and descriptions ----------------------------------------------------------------


@query
def section_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = urls.url_path(F.col("url"))
    return derived.url_variants(spark, sf_dir).select(
        "page_id", "variant",
        sections.section_of_path(urls.page_segments(path)).alias("section"),
    )


@query
def section_titlecase(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.concat(
        F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("_"), F.lower("p_type"),
        F.lit("-état.x2y"),
    )
    year = F.concat(F.lit("20"), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return derived.table(spark, sf_dir, "part").select(
        "p_partkey",
        text.title_case(segment).alias("name"),
        sections.section_of_segment(
            F.when(F.col("p_partkey") % 3 == 0, year)
            .when(F.col("p_partkey") % 3 == 1, F.lit("Tutorials"))
            .otherwise(F.col("p_type"))
        ).alias("section"),
    )


def _section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = urls.page_segments(urls.path_as_written(F.col("url")))
    empty = F.lit("")
    return derived.flat_pages(spark, sf_dir).select(
        "site", "url", empty.alias("title"), empty.alias("description"),
        empty.alias("fallback_description"), sections.section_of_path(segments).alias("section"),
    )


@query
def regroup_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.describe_pages(_section_pages(spark, sf_dir)).select(
        "site", "url", "section", "index_section"
    )


def _document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source; the language stands for the description."""
    url = F.concat(F.lit("https://"), F.col("source"), F.lit("/d/"), F.col("doc_id").cast("string"))
    return derived.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("site"),
        url.alias("url"),
        F.lit("").alias("title"),
        F.when(F.col("doc_id") % 10 == 0, F.lit("")).otherwise(F.col("lang")).alias("description"),
        F.concat(F.lit("fallback "), F.col("doc_id").cast("string")).alias("fallback_description"),
        F.lit("D").alias("section"),
    )


@query
def generic_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _document_pages(spark, sf_dir)
    totals = pages.groupBy("site").agg(F.count(F.lit(1)).alias("n_pages"))
    return describe.generic_descriptions(pages, totals)


@query
def pick_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.describe_pages(_document_pages(spark, sf_dir)).select(
        "doc_id", F.col("index_description").alias("description")
    )


@query
def section_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _section_pages(spark, sf_dir)
        .groupBy("site", "section")
        .agg(F.count(F.lit(1)).alias("n_pages"), F.min("url").alias("first_url"))
    )


@query
def section_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = urls.url_path(F.col("url"))
    section = sections.section_of_path(urls.page_segments(path))
    return derived.url_variants(spark, sf_dir).select(
        "page_id", "variant", section.alias("section"), sections.section_rank(section).alias("rank")
    )


# -- admission ----------------------------------------------------------------------------


@query
def glob_to_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    glob = F.concat(
        F.lit("/"), F.lower("p_type"), F.lit("/**/"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit("*")), F.lit(".html"),
    )
    return derived.table(spark, sf_dir, "part").select(
        "p_partkey",
        urls.glob_to_regex(glob).alias("regex"),
        urls.glob_to_regex(glob, escape=True).alias("escaped_regex"),
    )


@query
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = lambda *globs: F.array(*[urls.glob_to_regex(F.lit(g)) for g in globs])
    return (
        derived.table(spark, sf_dir, "pages")
        .select("page_id", urls.url_path(F.col("url")).alias("path"))
        .filter(admission.globs_allow(F.col("path"), rx("/en/**", "/f*/*"), rx("/*/1*", "/**7")))
    )


@query
def locale_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        derived.table(spark, sf_dir, "pages")
        .select("page_id", urls.url_path(F.col("url")).alias("path"))
        .filter(admission.locale_allows(F.col("path"), F.lit("en")))
        .select("page_id")
    )


@query
def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    no_rules = F.array().cast(robots.RULES)
    none = F.array().cast("array<string>")
    pages = derived.locale_copies(spark, sf_dir).withColumns(
        {"lang": F.lit("en"), "include_rx": none, "exclude_rx": none, "rules": no_rules}
    )
    checked = admission.check_urls(pages)
    kept = checked.filter(F.col("skip_reason").isNull())
    return admission.first_by(kept, ["site", "claim"], ["page_id"]).select(
        "page_id", "site", "norm_url", "claim"
    )


@query
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.table(spark, sf_dir, "pages").select("page_id", "url")
    copies = pages.filter("page_id % 5 = 0").select(
        (-F.col("page_id") - 1).alias("page_id"),
        F.concat(F.regexp_extract("url", "^[^?#]*", 0), F.lit("?copy")).alias("url"),
    )
    both = admission.identify_pages(pages.unionByName(copies))
    return admission.unique_pages(both).select("page_id", "url")


@query
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    directives = robots.robots_directives(derived.host_robots(spark, sf_dir))
    return robots.robots_rules(directives).select(
        "site", "line_no", "allow", "pattern", F.array_join("pieces", "*").alias("plain"), "anchored", "len"
    )


@query
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    directives = robots.robots_directives(derived.host_robots(spark, sf_dir))
    rules = robots.site_rules(robots.robots_rules(directives))
    pages = tables.read_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "site", "url")
    joined = spread_join(pages, rules, "site", "url")
    allowed = robots.robots_allow(urls.url_path(F.col("url")), F.col("rules"))
    return joined.select("page_id", allowed.alias("allowed"))


@query
def robots_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``robots_allowed`` through an index of the rules' literal prefixes: only candidate rules are matched."""
    directives = robots.robots_directives(derived.host_robots(spark, sf_dir))
    rules = robots.robots_rules(directives)
    pages = tables.read_pages(spark, f"{sf_dir}/pages.parquet").select(
        "page_id", "site", urls.url_path(F.col("url")).alias("path")
    )
    return indexed_robots(pages, rules).select("page_id", "allowed")


@query
def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = derived.page_hosts(spark, sf_dir)
    sites = tables.complete_sites(
        hosts.select(F.concat(F.lit("http://"), F.col("site"), F.lit("/a/b")).alias("base_url"))
    )
    directives = robots.robots_directives(derived.host_robots(spark, sf_dir))
    return robots.sitemap_locations(sites, directives)


# -- sitemaps -------------------------------------------------------------------------------


@query
def sitemap_locs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemaps.sitemap_locs(derived.supplier_sitemaps(spark, sf_dir))


def _closure(spark: SparkSession, sf_dir: str, workspace: Workspace) -> tuple[DataFrame, DataFrame]:
    sites = tables.complete_sites(derived.supplier_sites(spark, sf_dir))
    starts = sites.select(
        "site", F.lit(0).alias("pos"),
        F.concat(F.col("base_url"), F.lit("/sitemap.xml")).alias("sitemap_url"),
    )
    files = derived.supplier_sitemaps(spark, sf_dir)
    return sites, sitemaps.sitemap_closure(starts, files, workspace)


@query
def sitemap_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _closure(spark, sf_dir, Workspace(spark))
    return found.select(
        "site", "url", F.array_join(F.col("path_pos").cast("array<string>"), ".").alias("place")
    )


@query
def sitemap_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    sites, found = _closure(spark, sf_dir, workspace)
    checked = sitemaps.classify_sitemap_urls(found, sites)
    kept, _ = sitemaps.cap_sitemap_urls(checked, sites, workspace)
    return kept.select("site", "url", "norm_url")


# -- reach ----------------------------------------------------------------------------------


@query
def reached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = site_index.discover(*_shop_inputs(spark, sf_dir), want_blocks=False).fetched
    return fetched.select("site", "url", "depth", "wave")


@query
def reach_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _shop_inputs(spark, sf_dir, capped=True)
    fetched = site_index.discover(*inputs, want_blocks=False).fetched
    return fetched.select("site", "url", "depth", "wave")


@query
def limit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and sitemap URLs that the limits of a site cut off."""
    found = site_index.discover(*_shop_inputs(spark, sf_dir, capped=True), want_blocks=False)
    cut = found.dropped.filter(F.startswith("skip_reason", F.lit("over the")))
    return cut.select("site", "url", "stage", "skip_reason")


@query
def site_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a site list that are refused, and why."""
    listed = tables.complete_sites(derived.listed_sites(spark, sf_dir))
    _, refused = admission.check_sites(listed, Workspace(spark))
    return refused.select(F.col("url").alias("base_url"), "skip_reason")


@query
def site_index_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages of sites that were fetched attempt by attempt were left out, and how many stayed."""
    products = site_index.index_fetched_sites(
        tables.complete_sites(derived.fetched_sites(spark, sf_dir)),
        derived.page_fetches(spark, sf_dir),
        derived.shop_robots(spark, sf_dir).limit(0),
        derived.shop_sitemaps(spark, sf_dir).limit(0),
        Workspace(spark),
        max_attempts=MAX_ATTEMPTS,
        max_body_bytes=5_000,
    )
    kept = products.pages.select("site", F.lit("kept").alias("stage"), F.lit("").alias("skip_reason"))
    return (
        products.dropped.select("site", "stage", "skip_reason")
        .unionByName(kept)
        .groupBy("site", "stage", "skip_reason")
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )


@query
def written_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all captured pages, written as a table of lines and read back."""
    workspace = Workspace(spark)
    products = site_index.index_captured_pages(_pages(spark, sf_dir), workspace)
    products.write(f"{workspace.path}/out", by_site=False)
    return (
        spark.read.parquet(f"{workspace.path}/out/index")
        .groupBy("site", "line")
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


@query
def skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why URLs were left out, over the whole run of ``site_index_crawled``."""
    return site_index.build_site_index(*_shop_inputs(spark, sf_dir)).skip_counts()


@query
def site_index_crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index rows of sites followed from their base page, with every rule in force."""
    products = site_index.build_site_index(*_shop_inputs(spark, sf_dir))
    return products.index().select("site", "part", "section", "url", "line")


@query
def detected_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = admission.identify_pages(_pages(spark, sf_dir)).withColumn(
        "html_lang", text.html_language(F.col("html"))
    )
    languages = admission.unique_pages(
        pages.select("page_id", "site", "captured_url", "url", "html_lang")
    )
    given = languages.groupBy("site").agg(F.min("url").alias("base_url"))
    named = F.when(F.length("site") % 3 == 0, F.lit("FR"))
    sites = tables.complete_sites(given.select("base_url", named.alias("lang")))
    no_rules = robots.site_rules(
        robots.robots_rules(robots.robots_directives(derived.host_robots(spark, sf_dir)))
    )
    return admission.site_policy(sites, no_rules, languages).select("site", "base_url", "lang")


# -- responses and extraction ------------------------------------------------------------------


@query
def final_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.final_attempts(derived.fetch_attempts(spark, sf_dir), MAX_ATTEMPTS).select(
        "url", "attempt", "status"
    )


@query
def response_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetches = derived.fetch_attempts(spark, sf_dir)
    return responses.classify_responses(fetches, MAX_ATTEMPTS, MAX_BODY_BYTES).select(
        "url", "skip_reason"
    )


@query
def extraction_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = derived.order_pages(spark, sf_dir)
    outcomes = extract.extract(pages, max_html_chars=MAX_HTML_CHARS)
    return (
        extract.dropped_pages(outcomes)
        .groupBy("site", "stage", "skip_reason")
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )


# -- products -----------------------------------------------------------------------------------


@query
def extracted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(spark, sf_dir).pages.select(
        "site", "url", "title", "description", "fallback_description", "markdown", "section"
    )


@query
def index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(spark, sf_dir).index()


@query
def site_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    products = site_index.index_captured_pages(_pages(spark, sf_dir), workspace)
    return assemble.index_documents(products.index(), workspace)


@query
def site_index_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = Workspace(spark)
    products = site_index.index_captured_pages(_pages(spark, sf_dir), workspace)
    return assemble.index_documents(products.index(), workspace, lines_per_chunk=7)


@query
def site_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(spark, sf_dir).full()


@query
def site_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _captured(spark, sf_dir)
    return assemble.listing_rows(products.pages, products.headers)


@query
def site_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(spark, sf_dir).json().select("site", "part", "url", "text")


@query
def site_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(spark, sf_dir).summary()


@query
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _captured(spark, sf_dir).run_counts()


@query
def size_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    reduced = assemble.size_reduction(_captured(spark, sf_dir).pages)
    return reduced.withColumn("reduction", F.round("reduction", 6))
