"""robots.txt, sitemaps, responses and link following on small hand-made sites."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitequarry.operators import responses, robots, sitemaps
from sitequarry.operators.admission import check_sites
from sitequarry.operators.lineage import Workspace
from sitequarry.operators.skew import number_rows, spread_join
from sitequarry.plans import derived
from sitequarry.plans.site_index import build_site_index, index_captured_pages
from sitequarry.sources.tables import complete_sites, read_html_files

SITE = "https://s.org"
SF_DIR = "/root/testdata/sf0.001"
PAGES = "page_id int, site string, url string, html string"
ROBOTS = "site string, status int, body string"
SITEMAPS = "sitemap_url string, status int, xml string"


def rules_of(spark, body, status=200):
    df = spark.createDataFrame([("s.org", status, body)], ROBOTS)
    return robots.site_rules(robots.robots_rules(robots.robots_directives(df)))


@pytest.mark.parametrize(
    "body,path,allowed",
    [
        ("User-agent: *\nDisallow: /a", "/a/b", False),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdfs", True),
        ("User-agent: *\nDisallow: /a.c", "/abc", True),
        ("User-agent: other\nDisallow: /", "/a", True),
        ("User-agent: other\nUSER-AGENT: *\ndisallow : /x # why", "/x", False),
        ("User-agent: *\nDisallow:", "/a", True),
        ("Disallow: /a", "/a", True),
        ("User-agent: *\nDisallow: /a\nUser-agent: b\nDisallow: /c", "/c", True),
        ("User-agent: *\nSitemap: /s.xml\nDisallow: /c", "/c", False),
        ("User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b", "/b", False),
        ("", "/a", True),
        ("User-agent: *\nDisallow: /**b", "/a/b", False),
        ("User-agent: *\nDisallow: /a*", "/a", False),
        ("User-agent: *\nDisallow: /a*$", "/ab", False),
        ("User-agent: *\nDisallow: /a*b$", "/ab/b", False),
        ("User-agent: *\nDisallow: /ab*b$", "/ab", True),
        ("User-agent: *\nDisallow: /a$", "/a", False),
        ("User-agent: *\nDisallow: /a$", "/a/", True),
        ("User-agent: *\nDisallow: /a*b*c", "/axcxb", True),
        ("User-agent: *\nDisallow: /a*b*c", "/axbxxc/", False),
        ("User-agent: *\nDisallow: *x", "/a/x", False),
        ("User-agent: *\nDisallow: /a$b", "/a$b", False),
    ],
)
def test_robots_rules(spark, body, path, allowed):
    pages = spark.createDataFrame([("s.org", path)], "site string, path string")
    joined = pages.join(rules_of(spark, body), "site", "left")
    assert joined.select(robots.robots_allow(F.col("path"), F.col("rules"))).first()[0] is allowed


def test_stars_do_not_make_a_path_slow(spark):
    rules = rules_of(spark, "User-agent: *\nDisallow: /******b\nDisallow: /*a*a*a*a*a*a*a*a*b")
    pages = spark.createDataFrame([("s.org", "/" + "a" * 10_000)] * 20, "site string, path string")
    start = time.time()
    allowed = pages.join(rules, "site").select(robots.robots_allow(F.col("path"), F.col("rules")))
    assert {r[0] for r in allowed.collect()} == {True}
    assert time.time() - start < 10


def test_one_robots_capture_per_site(spark):
    bodies = [("s.org", 404, "User-agent: *\nDisallow: /"), ("s.org", 200, "User-agent: *\nDisallow: /a"), ("s.org", 200, "User-agent: *\nDisallow: /a")]
    directives = robots.robots_directives(spark.createDataFrame(bodies, ROBOTS))
    assert [r.value for r in directives.orderBy("line_no").collect()] == ["*", "/a"]


def test_failed_robots_allow_everything(spark):
    assert rules_of(spark, "User-agent: *\nDisallow: /", 500).count() == 0


@pytest.mark.parametrize(
    "body,expected",
    [
        ("User-agent: *\nAllow: /\nSitemap: https://s.org/a.xml\nSitemap: https://s.org/b.xml", ["https://s.org/a.xml", "https://s.org/b.xml"]),
        ("User-agent: *\nAllow: /", ["https://s.org/sitemap.xml"]),
        ("", ["https://s.org/sitemap.xml"]),
        ("sitemap: /maps/main.xml", ["https://s.org/maps/main.xml"]),
        ("Sitemap: /m.xml?v=2", ["https://s.org/m.xml?v=2"]),
    ],
)
def test_sitemap_locations(spark, body, expected):
    sites = complete_sites(spark.createDataFrame([(SITE,)], "base_url string"))
    directives = robots.robots_directives(spark.createDataFrame([("s.org", 200, body)], ROBOTS))
    found = robots.sitemap_locations(sites, directives).orderBy("pos").collect()
    assert [r.sitemap_url for r in found] == expected


def closure(spark, workspace, files, starts=("a.xml",)):
    xml = [
        (f"{SITE}/{n}", 200, "".join(f"<loc>{SITE}/{x}</loc>" for x in locs.split())) for n, locs in files.items()
    ]
    begin = [("s.org", i, f"{SITE}/{n}") for i, n in enumerate(starts)]
    found = sitemaps.sitemap_closure(
        spark.createDataFrame(begin, "site string, pos int, sitemap_url string"),
        spark.createDataFrame(xml, SITEMAPS),
        workspace,
    )
    return [r.url[len(SITE) + 1 :] for r in sorted(found.collect(), key=lambda r: r.path_pos)]


def test_sitemap_walk_is_depth_first(spark, workspace):
    files = {"a.xml": "b.xml c.xml p0", "b.xml": "c.xml p1", "c.xml": "p2 a.xml p3", "d.xml": "p4"}
    assert closure(spark, workspace, files) == ["p2", "p3", "p1", "p0"]


def test_sitemap_walk_lowers_paths_found_early(spark, workspace):
    # e is met first through d (two steps), but the walk reaches it through b, c, then e
    files = {"a.xml": "b.xml d.xml", "b.xml": "c.xml", "c.xml": "e.xml q", "d.xml": "e.xml r", "e.xml": "f.xml s", "f.xml": "t b.xml"}
    assert closure(spark, workspace, files) == ["t", "s", "q", "r"]


def test_sitemap_urls_repeat_and_starts_count_once(spark, workspace):
    files = {"a.xml": "p p", "b.xml": "a.xml p"}
    assert closure(spark, workspace, files, ("a.xml", "b.xml", "a.xml")) == ["p", "p", "p"]


def test_repeated_sitemap_captures_count_once(spark, workspace):
    xml = [(f"{SITE}/a.xml", 200, f"<loc>{SITE}/p</loc><loc>{SITE}/q</loc>")] * 2 + [(f"{SITE}/a.xml", 500, "<loc>x</loc>")]
    starts = spark.createDataFrame([("s.org", 0, f"{SITE}/a.xml")], "site string, pos int, sitemap_url string")
    found = sitemaps.sitemap_closure(starts, spark.createDataFrame(xml, SITEMAPS), workspace)
    assert sorted(r.url for r in found.collect()) == [f"{SITE}/p", f"{SITE}/q"]


def test_limits_report_what_they_cut(spark, workspace):
    n = 1_500
    host = "long.s.org"
    listed = "".join(f"<loc>https://{host}/p/{i:04d}</loc>" for i in range(n))
    pages = [(0, host, f"https://{host}/", html("/a", "/b", "/c"))]
    pages += [(1 + i, host, f"https://{host}/p/{i:04d}", html()) for i in range(n)]
    pages += [(9000 + i, host, f"https://{host}/{x}", html()) for i, x in enumerate("abc")]
    inputs = (
        spark.createDataFrame(pages, PAGES),
        spark.createDataFrame([], ROBOTS),
        spark.createDataFrame([(f"https://{host}/sitemap.xml", 200, listed)], SITEMAPS),
        workspace,
    )
    everything = {p[2] for p in pages}
    for options, kept, reasons in (
        ({}, n + 4, {}),
        ({"max_sitemap_urls": 1_200}, 1_204, {"over the sitemap limit": 300}),
        ({"max_pages": 3}, 3, {"over the sitemap limit": n - 2, "over the page limit": 3}),
    ):
        schema = "base_url string" + "".join(f", {k} int" for k in options)
        sites = complete_sites(spark.createDataFrame([(host, *options.values())], schema))
        built = build_site_index(sites, *inputs)
        urls = [r.url for r in built.pages.collect()]
        dropped = [(r.url, r.skip_reason) for r in built.dropped.collect()]
        assert len(urls) == len(set(urls)) == kept
        counts = Counter(reason for _, reason in dropped)
        assert counts == reasons
        assert set(urls) | {u for u, _ in dropped} == everything


def test_site_rows_that_cannot_be_used_are_reported(spark, workspace):
    rows = [
        ("good.org", ["/a(b)*"]),
        ("good.org/second", []),
        ("http://bad host/x", []),
        ("odd.org", ["/a(b"]),
        ("odder.org", ["/x", "[a"]),
    ]
    sites = complete_sites(spark.createDataFrame(rows, "base_url string, exclude array<string>"))
    good, refused = check_sites(sites, workspace)
    assert [r.site for r in good.collect()] == ["good.org"]
    assert sorted((r.url, r.skip_reason) for r in refused.collect()) == [
        ("http://bad host/x", "invalid url"),
        ("https://good.org/second", "duplicate site"),
        ("https://odd.org", "invalid pattern"),
        ("https://odder.org", "invalid pattern"),
    ]
    assert check_sites(sites, workspace, escape_globs=True)[0].count() == 3


def test_page_ids_need_not_be_unique(spark, workspace):
    text = html()
    rows = [(1, "a.org", "https://a.org/x?y", text), (1, "a.org", "https://a.org/x", text), (1, "a.org", "https://a.org/z", text)]
    built = index_captured_pages(spark.createDataFrame(rows, PAGES), workspace)
    assert sorted(r.url for r in built.pages.collect()) == ["https://a.org/x", "https://a.org/z"]
    assert [(r.url, r.skip_reason) for r in built.dropped.collect()] == [("https://a.org/x?y", "duplicate")]


def test_a_capture_that_is_there_more_than_once_is_one_page(spark, workspace):
    text = html()
    rows = [(1, "a.org", "https://a.org/x", text)] * 3 + [(None, "a.org", "https://a.org/y", text)] * 2
    rows += [(2, "a.org", "https://a.org/x?q", text)] * 2 + [(4, "a.org", "https://a.org/z", text)]
    built = index_captured_pages(spark.createDataFrame(rows, PAGES), workspace)
    assert sorted(r.url for r in built.pages.collect()) == [f"https://a.org/{x}" for x in "xyz"]
    dropped = sorted((r.url, r.skip_reason) for r in built.dropped.collect())
    urls = ["https://a.org/x"] * 2 + ["https://a.org/x?q"] * 2 + ["https://a.org/y"]
    assert dropped == [(url, "duplicate") for url in urls]


def test_copies_of_a_page_table_do_not_multiply(spark, workspace):
    sites = complete_sites(spark.createDataFrame([("https://a.org",)], "base_url string"))
    pages = [(1, "a.org", "https://a.org/", html("/a")), (2, "a.org", "https://a.org/a", html("/"))]
    none = [spark.createDataFrame([], schema) for schema in (ROBOTS, SITEMAPS)]
    built = build_site_index(sites, spark.createDataFrame(pages * 3, PAGES), *none, workspace)
    assert sorted(r.url for r in built.pages.collect()) == ["https://a.org/", "https://a.org/a"]
    assert built.dropped.count() == 4 and built.facts.first().n_pages == 2


def test_more_hot_keys_than_a_short_list_holds(spark):
    big = spark.range(6_000).select((F.col("id") % 1_500).alias("k"), "id")
    small = spark.range(1_500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = spread_join(big, small, "k", "id", rows_per_salt=2)
    assert joined.filter("v = 2 * k").count() == 6_000
    plan = joined._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" not in plan and "broadcast" not in plan.lower()


def test_responses(spark):
    ok = ("text/html", None, "<html>")
    rows = [
        ("retried", 1, 503, *ok), ("retried", 2, 200, *ok), ("retried", 3, 404, *ok),
        ("gives up", 1, 500, *ok), ("gives up", 2, 502, *ok), ("gives up", 3, 429, *ok),
        ("fourth", 3, 503, *ok), ("fourth", 4, 200, *ok),
        ("plain", 1, 200, "text/plain", None, "x"), ("untyped", 1, 200, None, None, "x"),
        ("declared", 1, 200, "text/html", 10485761, "x"), ("limit", 1, 200, "text/html", 10485760, "x"),
        ("pdf", 1, 200, "text/html", None, "%PDF-1"), ("zip", 1, 200, "text/html", None, "PK\x03"),
        ("empty", 1, 200, "text/html", None, ""), ("large", 1, 200, "text/html", None, "é" * 5242881),
        ("failed", 1, None, None, None, None),
        ("recovered", 1, None, None, None, None), ("recovered", 2, 200, *ok),
    ]
    df = spark.createDataFrame(rows, "url string, attempt int, status int, content_type string, content_length long, body string")
    classified = responses.classify_responses(df, max_attempts=3, max_body_bytes=10_485_760)
    found = {r.url: r.skip_reason for r in classified.collect()}
    assert found == {
        "retried": None, "gives up": "bad status", "fourth": "bad status", "plain": "not html",
        "untyped": "not html", "declared": "declared too large", "limit": None, "pdf": "binary content",
        "zip": "binary content", "empty": "empty body", "large": "body too large", "failed": "bad status",
        "recovered": None,
    }
    kept = responses.pages_from_fetches(classified).collect()
    assert {r.url for r in kept} == {"retried", "limit", "recovered"} and all(r.page_id for r in kept)
    refused = responses.refused_fetches(classified)
    assert refused.count() + len(kept) == len(found)
    unlimited = {r.url: r.skip_reason for r in responses.classify_responses(df).collect()}
    assert unlimited["fourth"] is unlimited["large"] is unlimited["declared"] is None


def test_refused_bodies_do_not_travel(spark):
    rows = [("pdf", 1, 200, "text/html", None, "%PDF-1"), ("large", 1, 200, "text/html", None, "x" * 100),
            ("css", 1, 200, "text/css", None, "x"), ("page", 1, 200, "text/html", None, "<html>")]
    df = spark.createDataFrame(rows, "url string, attempt int, status int, content_type string, content_length long, body string")
    found = {r.url: (r.body, r.body_bytes) for r in responses.classify_responses(df, max_body_bytes=50).collect()}
    assert found == {"pdf": (None, 6), "large": (None, 100), "css": (None, 1), "page": ("<html>", 6)}


def test_derived_pages_are_spread_by_rows(spark, monkeypatch):
    monkeypatch.setattr(derived, "ROWS_PER_TASK", 50)
    for pages in (derived.shop_pages(spark, SF_DIR), derived.page_fetches(spark, SF_DIR)):
        parts = pages.select(F.spark_partition_id().alias("part")).distinct().count()
        assert parts == derived.table(spark, SF_DIR, "customer").count() // 50 + 1


def html(*links, lang=""):
    body = "".join(f'<a href="{x}">{x}</a> ' for x in links)
    return (
        f"<html{lang}><title>T</title><main><p>A page with enough text to be kept, whatever it links to.</p>"
        f"<p>{body}</p></main></html>"
    )


CHAIN = {
    "/": html("/a", "/b.html#x", "https://other.org/"),
    "/a": html("/c", "/", "/missing"),
    "/b": html("c?q=1"),
    "/c": html("/d/"),
    "/d": html("/e"),
    "/e": html(),
    "/lonely": html(),
}
DOCS = {
    "/": html("/docs/a", "/docs/b", "/blog/c", "/docs/x/y"),
    **{p: html() for p in ("/docs/a", "/docs/b", "/blog/c", "/docs/x/y")},
}
LOCALES = {
    "/": html("/en/x", "/x", "/de/x", "/de/y", "/z", "/en/z", lang=' lang="en-GB"'),
    **{p: html() for p in ("/en/x", "/x", "/de/x", "/de/y", "/en/z")},
}
# name: pages, site options, robots.txt, sitemap paths
SCENARIOS = {
    "depth0": (CHAIN, {"depth": 0}, "", None),
    "depth1": (CHAIN, {"depth": 1}, "", None),
    "depth2": (CHAIN, {"depth": 2}, "", None),
    "depth3": (CHAIN, {"depth": 3}, "", None),
    "defaults": (CHAIN, {}, "", None),
    "capped": (CHAIN, {"max_pages": 3}, "", None),
    "listed": (CHAIN, {"lang": "en"}, "", ["/c", "/lonely?x", "/", "/1/2/3/4", "/de/x"]),
    "listed-capped": (CHAIN, {"max_pages": 2}, "", ["/lonely", "/c"]),
    "excluding": (DOCS, {"exclude": ["/docs/*"]}, "", None),
    "including": (DOCS, {"include": ["/", "/docs/**"]}, "User-agent: *\nDisallow: /docs/b", None),
    "including-less": (DOCS, {"include": ["/docs/**"]}, "", None),
    "detected": (LOCALES, {}, "", None),
    "german": (LOCALES, {"lang": "DE"}, "", None),
    "any-language": (dict(LOCALES, **{"/": html("/en/x", "/x", "/de/x")}), {}, "", None),
    "base-below": (dict(CHAIN, **{"/a/": html("b")}), {"base": "/a/"}, "", None),
}


def crawl(spark, workspace):
    """All scenarios as sites of one run."""
    sites, pages, bodies, maps = [], [], [], []
    for name, (captured, options, body, listed) in SCENARIOS.items():
        host = f"{name}.s.org"
        order = ("depth", "max_pages", "lang", "include", "exclude")
        sites.append((host + options.get("base", ""), *[options.get(k) for k in order]))
        pages += [(host, f"https://{host}{path}", content) for path, content in captured.items()]
        bodies.append((host, 200, body))
        if listed is not None:
            xml = "".join(f"<loc>https://{host}{p}</loc>" for p in listed)
            maps.append((f"https://{host}/sitemap.xml", 200, xml))
    site_schema = (
        "base_url string, depth int, max_pages int, lang string, include array<string>, "
        "exclude array<string>"
    )
    return build_site_index(
        complete_sites(spark.createDataFrame(sites, site_schema)),
        spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], PAGES),
        spark.createDataFrame(bodies, ROBOTS),
        spark.createDataFrame(maps, SITEMAPS),
        workspace,
    )


@pytest.fixture(scope="module")
def crawled(spark):
    built = crawl(spark, Workspace(spark))
    kept = {name: [] for name in SCENARIOS}
    dropped = {name: [] for name in SCENARIOS}
    for r in built.pages.collect():
        kept[r.site[: -len(".s.org")]].append("/" + r.url.split("/", 3)[3])
    for r in built.dropped.collect():
        dropped[r.site[: -len(".s.org")]].append(("/" + r.url.split("/", 3)[3], r.stage, r.skip_reason))
    index = sorted(map(tuple, built.index().collect()))
    assert [r.site for r in built.empty_sites().collect()] == ["including-less.s.org"]
    assert "including-less.s.org" not in {r[0] for r in index}
    return {k: sorted(v) for k, v in kept.items()}, {k: sorted(v) for k, v in dropped.items()}, index


@pytest.mark.parametrize(
    "name,expected",
    [
        ("depth0", ["/"]),
        ("depth1", ["/", "/a", "/b"]),
        ("depth2", ["/", "/a", "/b", "/c"]),
        ("depth3", ["/", "/a", "/b", "/c", "/d"]),
        ("defaults", ["/", "/a", "/b", "/c", "/d"]),
        ("capped", ["/", "/a", "/b"]),
        ("listed", ["/", "/a", "/b", "/c", "/lonely"]),  # /d hangs on /c only
        ("listed-capped", ["/", "/lonely"]),
        ("excluding", ["/", "/blog/c", "/docs/x/y"]),
        ("including", ["/", "/docs/a", "/docs/x/y"]),
        ("including-less", []),  # the base page has to match too
        ("detected", ["/", "/en/x"]),
        ("german", ["/", "/de/y", "/x"]),
        ("any-language", ["/", "/de/x", "/en/x", "/x"]),
        ("base-below", ["/", "/a", "/b", "/c", "/d", "/e"]),
    ],
)
def test_reached_pages(crawled, name, expected):
    assert crawled[0][name] == expected


def test_reasons(crawled):
    dropped = crawled[1]
    assert dropped["depth2"] == [("/missing", "response", "non-HTML or failed")]
    assert {r[2] for r in dropped["listed"] if r[1] == "sitemap"} == {"base url", "too deep", "locale"}
    assert ("/docs/b", "admission", "robots.txt blocked") in dropped["including"]
    assert ("/blog/c", "admission", "excluded") in dropped["including"]
    # /z is missing but claims its path all the same
    assert dropped["detected"] == [
        ("/de/x", "admission", "locale de (want en)"),
        ("/de/y", "admission", "locale de (want en)"),
        ("/en/z", "admission", "locale duplicate"),
        ("/x", "admission", "locale duplicate"),
        ("/z", "response", "non-HTML or failed"),
    ]


def test_result_does_not_depend_on_partitions(spark, workspace, crawled):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    built = crawl(spark, workspace)
    again = sorted(map(tuple, built.index().collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == crawled[2]
    workspace.drop()


def test_spread_join_splits_hot_keys(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    small = big.groupBy("k").agg(F.max("id").alias("top")).filter("k <> 'k3'")
    joined = spread_join(big, small, "k", "id", rows_per_salt=100)
    plain = big.join(small, "k", "left")
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, plain.select(joined.columns).collect()))
    assert spread_join(big, small, "k", "id", how="inner", rows_per_salt=100).count() == plain.filter("top is not null").count()


def test_number_rows_across_partitions(spark, workspace):
    df = spark.range(500).select(F.when(F.col("id") % 4 < 3, "hot").otherwise("cold").alias("k"), (F.col("id") * 7919 % 501).alias("v"))
    numbered = number_rows(df.repartition(6), "k", [F.col("v")], workspace).collect()
    for key in ("hot", "cold"):
        rows = sorted((r.position, r.v) for r in numbered if r.k == key)
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
        assert [v for _, v in rows] == sorted(v for _, v in rows)


def test_html_files_as_pages(spark, workspace, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.html").write_text("<p>a</p>")
    (tmp_path / "index.html").write_text("<p>i</p>")
    (tmp_path / "docs" / "a b.html").write_text(html())
    for root in (str(tmp_path), f"file://{tmp_path}/", f"{tmp_path}/docs/.."):
        rows = read_html_files(spark, root, "https://s.org/").orderBy("url").collect()
        assert [(r.site, r.url) for r in rows] == [
            ("s.org", "https://s.org/docs/a%20b.html"), ("s.org", "https://s.org/docs/a.html"), ("s.org", "https://s.org/index.html"),
        ]
    assert len({r.page_id for r in rows}) == 3
    built = index_captured_pages(read_html_files(spark, str(tmp_path), "https://s.org"), workspace)
    assert [r.url for r in built.pages.collect()] == ["https://s.org/docs/a%20b"]
    assert built.dropped.count() == 2
