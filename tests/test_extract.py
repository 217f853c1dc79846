"""Extraction of single pages: what is kept, what is dropped and why."""

import pytest
from pyspark.sql import functions as F

from sitequarry.operators.extract import extract, extract_parsed, parse_for_extraction

PROSE = (
    "<p>Tides in the northern bay rise by four metres twice a day.\n"
    "  Boats wait for them outside the lock. Pilots board at the outer buoy.</p>"
    "<p>In winter the channel is dredged, as storms carry sand into it.</p>"
)
MINIMAL = f"<title>Harbour notes</title><article><h1>Tides</h1>{PROSE}</article>"
FULL = (
    '<head><meta property="og:title" content="Bay pilots"><title>Pilots | Bay</title>'
    '<meta name="description" content="How ships enter the bay"></head>'
    '<header><a href="/fleet">Fleet</a></header><aside>Weather: calm</aside>'
    f"<main><h1>Entering</h1><article>{PROSE}</article></main>"
    "<style>p { margin: 0 }</style><footer>Port office</footer>"
)


def run(spark, *pages, min_content=50, max_html_chars=None):
    rows = [(str(i), f"https://example.com{path}", html) for i, (path, html) in enumerate(pages)]
    df = spark.createDataFrame(rows, "site string, url string, html string")
    found = extract(df, min_content, max_html_chars).collect()
    return sorted(found, key=lambda r: int(r.site))


def test_kept_pages(spark):
    minimal, full, untitled = run(
        spark,
        ("/docs/intro", MINIMAL),
        ("/docs/intro", FULL),
        ("/docs/intro", f"<html><head></head><body><article>{PROSE}</article></body></html>"),
    )
    assert minimal.skip_reason is None and minimal.title == "Harbour notes"
    assert "outer buoy" in minimal.markdown and minimal.description == ""
    assert full.title == "Bay pilots" and full.description == "How ships enter the bay"
    assert full.fallback_description == "Tides in the northern bay rise by four metres twice a day."
    assert not any(x in full.markdown for x in ("margin", "Port office", "calm", "Fleet"))
    assert full.markdown.startswith("# Entering\n\nTides in the northern bay")
    assert untitled.skip_reason == "no title or description"


def test_dropped_pages(spark):
    title = "<title>T</title>"
    cases = [
        ("short body", "<html><head><title>T</title></head><body></body></html>"),
        ("no title or description", "<html><body></body></html>"),
        ("short body", f"<html><head>{title}</head><body>" + "<div>" * 1000 + "</body></html>"),
        ("html too large", f"{title}<article><p>{'x' * 7_000}</p></article>"),
        ("meta refresh", title + '<META HTTP-EQUIV="Refresh" content="0">' + PROSE),
        ("redirect title", "<title>You are being REDIRECTED</title>" + PROSE),
        ("no main content", title + "<nav>" + "word " * 20 + "</nav>"),
        ("no html", None),
        ("short markdown", title + "<main><p>tiny</p></main><div>" + "w " * 40 + "</div>"),
    ]
    rows = run(spark, *[("/x/y", html) for _, html in cases], max_html_chars=6_000)
    assert [r.skip_reason for r in rows] == [reason for reason, _ in cases]


def test_pages_that_could_not_be_read_or_written(spark):
    pages = spark.createDataFrame([("s", "https://s.org/a", f"<title>T</title><main>{PROSE}</main>")], "site string, url string, html string")
    parsed = parse_for_extraction(pages)
    failed = parsed.withColumn("parse_error", F.lit("error"))
    bare = F.transform("blocks", lambda b: b.withField("runs", F.array().cast(b_runs(parsed))))
    empty = parsed.withColumn("blocks", bare)
    for rows, reason in ((failed, "parse error"), (empty, "empty markdown")):
        assert [r.skip_reason for r in extract_parsed(rows).collect()] == [reason]


def b_runs(parsed):
    return parsed.schema["blocks"].dataType.elementType["runs"].dataType


def test_minimum_length_is_respected(spark):
    page = ("/a/b", "<title>T</title><main><p>Twenty characters ok</p></main>")
    assert run(spark, page)[0].skip_reason == "short body"
    assert run(spark, page, min_content=10)[0].skip_reason is None


@pytest.mark.parametrize(
    "path,section",
    [
        ("/", "Home"),
        ("/about", "Home"),
        ("/docs/intro", "Documentation"),
        ("/getting-started/setup", "Getting Started"),
        ("/api_reference/endpoints", "Api Reference"),
        ("/api/endpoints", "API Reference"),
        ("/2025/03/31/my-post", "Blog"),
        ("/posts/hello-world", "Blog"),
        ("/tutorials/setup", "Guides"),
        ("/faq/general", "FAQ"),
        ("/constructor/x", "Constructor"),
        ("/DOCS/x.html", "Documentation"),
        ("/docs.html", "Home"),
    ],
)
def test_section(spark, path, section):
    assert run(spark, (path, FULL))[0].section == section


def test_metadata_fallbacks(spark):
    body = f"<body><article>{PROSE}</article></body>"
    empty_og, blank_h1, og_description = run(
        spark,
        ("/", f'<head><meta property="og:title" content=""><title>From &lt;title&gt;</title></head>{body}'),
        ("/", f"<head><title>Unused</title></head><body><h1> </h1><article>{PROSE}</article></body>"),
        ("/", f'<meta name="description" content=""><meta property="og:description" content=" d ">{body}'),
    )
    assert empty_og.title == "From <title>"
    # a blank h1 still hides <title> as metadata, but not as the final title
    assert blank_h1.skip_reason == "no title or description"
    assert og_description.description == "d" and og_description.skip_reason is None


def test_content_without_main_element(spark):
    long = "word " * 30
    html = (
        "<title>T</title><div><a href='/'>Home</a> <a href='/a'>About us</a></div>"
        f"<p>{long}first.</p><p>{long}second.</p>"
        "<div><a href='/x'>one</a> <a href='/y'>two</a> <a href='/z'>three</a></div>"
    )
    (row,) = run(spark, ("/a/b", html))
    assert row.skip_reason is None
    assert "first" in row.markdown and "second" in row.markdown
    assert "About us" not in row.markdown and "three" not in row.markdown


def test_markdown_forms(spark):
    html = (
        "<title>T</title><main><h2>Head <em>x</em></h2>"
        '<p>Some <b>bold </b>text, a <a href="../y?q=1#f">link</a>, <code>a_b</code>, 3*4.<br>Next'
        '<img src="i.png" alt="gone"></p>'
        "<ul><li>one<li>two<ul><li>in</ul></li><li><input type=checkbox checked> done</ul>"
        "<ol start=3><li>three<li>four</ol>"
        '<pre><code class="language-py">if a &lt; b:\n    pass\n</code></pre>'
        "<blockquote><p>said</p></blockquote><hr>"
        "<table><tr><th>A</th><th>B|</th></tr><tr><td>1<td>2</table>"
        "<p>1. no list</p><p><del>old</del></p></main>"
    )
    (row,) = run(spark, ("/d/p", html))
    assert row.markdown == "\n\n".join(
        [
            "## Head _x_",
            "Some **bold** text, a [link](https://example.com/y?q=1#f), `a_b`, 3\\*4.  \nNext",
            "-   one\n-   two\n    -   in\n-   [x] done",
            "3.  three\n4.  four",
            "```py\nif a < b:\n    pass\n```",
            "> said",
            "* * *",
            "| A | B\\| |\n| --- | --- |\n| 1 | 2 |",
            "1\\. no list",
            "~old~",
        ]
    )
