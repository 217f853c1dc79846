"""URL and text expressions on the cases the test tables do not hold."""

import pytest
from pyspark.sql import functions as F

from sitequarry.functions import text, urls


def values(spark, function, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_normalize_url(spark):
    cases = {
        "https://Ex.COM": "https://ex.com/",
        "https://ex.com:443/a/../c/./d/..?x#y": "https://ex.com/c",
        "http://ex.com/\u00fc/x y": "http://ex.com/%C3%BC/x%20y",
        "http://ex.com/index.html": "http://ex.com/",
        "http://ex.com/a/index.php/": "http://ex.com/a",
        "http://ex.com/a/myindex.html": "http://ex.com/a/myindex",
        "http://ex.com/.html": "http://ex.com/",
        "http://ex.com/a.html.html": "http://ex.com/a.html",
        "http://ex.com//": "http://ex.com/",
        "http://ex.com:8080\\a\\b.htm": "http://ex.com:8080/a/b",
        "http://ex.com/%2E%2e/x": "http://ex.com/x",
        "http://ex.com/a.HTML": "http://ex.com/a.HTML",
        "http://www.ex.com/a": "http://www.ex.com/a",
        "ftp://ex.com/": None,
        "no url": None,
        "http://ex.com:99999/": None,
        "http:///": None,
    }
    assert values(spark, urls.normalize_url, cases) == list(cases.values())


def test_resolve_href(spark):
    cases = {
        "/x": "http://s.com/x",
        "/": "http://s.com/",
        "/x/?q": "http://s.com/x/",
        "/x/./y/../z": "http://s.com/x/z",
        "/x//y": "http://s.com/x//y",
        "/x%20y/a.b": "http://s.com/x%20y/a.b",
        "/x/%2e%2E/y": "http://s.com/y",
        "/x y": "http://s.com/x%20y",
        '/x"<>`{}^|[]': "http://s.com/x%22%3C%3E%60%7B%7D%5E|[]",
        "/x.": "http://s.com/x.",
        "x/y?q#f": "http://s.com/a/b/x/y",
        "../z": "http://s.com/a/z",
        "../../../z/": "http://s.com/z/",
        "//o.com/p": "http://o.com/p",
        "?q": "http://s.com/a/b/c",
        "#f": "http://s.com/a/b/c",
        "HTTPS://O.com/p": "https://o.com/p",
        " /sp ace\n/\u00e9": "http://s.com/sp%20ace/%C3%A9",
        "mailto:x@y": None,
        "javascript:void(0)": None,
        "http:rel": "http://s.com/a/b/rel",
        "\\back": "http://s.com/back",
    }
    page = urls.url_parts(F.lit("http://s.com/a/b/c"))
    resolve = lambda c: urls.href(urls.resolve_href(c, page))
    assert values(spark, resolve, cases) == list(cases.values())


def test_locale(spark):
    paths = ["/en/x", "/zh-CN", "/english/x", "/js/", "/", "/pt-br/a", "/e/x"]
    assert values(spark, urls.path_locale, paths) == ["en", "zh-cn", None, "js", None, "pt-br", None]
    assert values(spark, urls.strip_locale, paths) == ["/x", "/", "/english/x", "/", "/", "/a", "/e/x"]


@pytest.mark.parametrize(
    "glob,path,matches",
    [
        ("/docs/**", "/docs/a/b", True),
        ("/docs/**", "/docs", False),
        ("/docs/*", "/docs/a", True),
        ("/docs/*", "/docs/a/b", False),
        ("/*.html", "/axhtml", True),
        ("/a", "/a/b", False),
        ("**/b", "/a/b", True),
    ],
)
def test_globs(spark, glob, path, matches):
    df = spark.createDataFrame([(glob, path)], "g string, p string")
    assert df.select(F.rlike(F.col("p"), urls.glob_to_regex(F.col("g")))).first()[0] is matches


def test_escaped_glob(spark):
    df = spark.createDataFrame([("/*.html", "/axhtml"), ("/*.html", "/a.html")], "g string, p string")
    rx = urls.glob_to_regex(F.col("g"), escape=True)
    assert [r[0] for r in df.select(F.rlike(F.col("p"), rx)).collect()] == [False, True]


def test_entities_decode_once(spark):
    assert values(spark, urls.decode_xml_entities, ["a&amp;lt;b&lt;&quot;&apos;&gt;"]) == ["a&lt;b<\"'>"]


def test_scheme_and_names(spark):
    assert values(spark, urls.ensure_scheme, ["ex.com", "http://a", "HTTPS://a"]) == [
        "https://ex.com", "http://a", "https://HTTPS://a",
    ]
    assert values(spark, urls.site_display_name, ["www.my-site.co.uk", "docs.x.com"]) == ["My-site", "Docs"]


def test_trim_and_blank_lines(spark):
    assert values(spark, text.trim_all, ["\u00a0\ufeff x \u2003\n", "\u200bx"]) == ["x", "\u200bx"]
    assert values(spark, text.collapse_blank_lines, ["\n a\n\n\n\nb\n\nc\n"]) == ["a\n\nb\n\nc"]


def test_first_sentence(spark):
    cases = {
        "# Heading\n\nThis is the first sentence. This is the second.": "This is the first sentence.",
        "# T\n\nShort\n\nThis is a longer line without a boundary": "This is a longer line without a boundary",
        "A" * 200 + ". Next sentence.": "A" * 147 + "...",
        "": "",
        "This line ends with a period.\nNext": "This line ends with a period.",
        "Version 1.2 is out now. Go": "Version 1.2 is out now.",
        "x" * 150: "x" * 150,
        "x" * 151: "x" * 147 + "...",
        "exactly twenty chars": "exactly twenty chars",
    }
    assert values(spark, text.first_sentence, cases) == list(cases.values())


def test_title_case(spark):
    assert values(spark, text.title_case, ["getting-started", "fooBar_v2", "\u00e9cole", "a.b"]) == [
        "Getting Started", "FooBar V2", "\u00e9Cole", "A.B",
    ]


def test_html_language(spark):
    html = ['<html class=a lang="en-US">', "<HTML LANG='De'>", "<html>", '<html data-lang="x">']
    assert values(spark, text.html_language, html) == ["en", "de", None, None]
