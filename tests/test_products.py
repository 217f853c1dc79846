"""Index, full bundle and JSON listing, from pages to files."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from sitequarry.operators import assemble, describe
from sitequarry.operators.lineage import Workspace
from sitequarry.plans.site_index import SiteProducts, index_captured_pages
from sitequarry.sinks.products import chosen_products

PAGE = "site string, url string, title string, description string, fallback_description string, markdown string, section string"
DROPPED = "site string, url string, stage string, skip_reason string"


HOST = "harbour.test"


def page(path, title="Locks", description="How the lock works", section="Port", **other):
    fallback = other.get("fallback", "Ships pass at high tide.")
    markdown = other.get("markdown", "# Locks\n\nShips pass at high tide.")
    return (HOST, f"https://{HOST}{path}", title, description, fallback, markdown, section)


def products(spark, pages, description="Notes from the bay", name="Harbour"):
    df = spark.createDataFrame(pages, PAGE)
    built = SiteProducts(df, spark.createDataFrame([], DROPPED), df, Workspace(spark))
    sites = spark.createDataFrame([(HOST,)], "site string")
    built.headers = sites.select(
        "site", F.lit("https://harbour.test").alias("base_url"), F.lit(name).alias("name"),
        F.lit(description).alias("description"),
    )
    return built


def document(rows, order, text):
    return "\n".join(r[0] for r in rows.orderBy("site", *order).select(text).collect()) + "\n"


def index(built):
    return document(built.index(), assemble.index_order(), "line")


def full(built):
    return document(built.full(), assemble.full_order(), "text")


def listing(built):
    return json.loads(document(built.json(), assemble.full_order(), "text"))


def test_index_of_one_page(spark):
    assert index(products(spark, [page("/port/locks")])) == (
        "# Harbour\n\n> Notes from the bay\n\n## Port\n\n"
        "- [Locks](https://harbour.test/port/locks): How the lock works\n"
    )


def test_index_without_descriptions(spark):
    built = products(spark, [page("/port/locks", description="", fallback="")], description="")
    assert index(built) == "# Harbour\n\n## Port\n\n- [Locks](https://harbour.test/port/locks)\n"


def test_index_orders_sections_and_pages(spark):
    pages = [
        page("/zeta/a", "Z", section="Zeta"),
        page("/docs/b", "B", section="Documentation"),
        page("/docs/a", "A", section="Documentation"),
        page("/blog/p", "P", section="Blog"),
        page("/about/us", "U", section="About"),
        page("/alpha/a", "L", section="alpha"),
        page("/", "H", section="Home"),
    ]
    lines = index(products(spark, pages)).split("\n")
    assert [x[3:] for x in lines if x.startswith("## ")] == [
        "Home", "Documentation", "Blog", "alpha", "Zeta", "About",
    ]
    assert [x[3] for x in lines if x.startswith("- [")] == list("HABPLZU")


def test_products_without_pages(spark):
    built = products(spark, [])
    assert index(built) == full(built) == "# Harbour\n\n> Notes from the bay\n"
    assert listing(built)["pages"] == []


def test_generic_descriptions_give_way(spark):
    same = "Everything about the bay"
    pages = [page(f"/a/{x}", x, same, fallback=f"About {x}.") for x in "abc"]
    pages.append(page("/a/d", "d", "Its own", fallback="Unused."))
    text = index(products(spark, pages))
    assert same not in text and "Unused" not in text
    assert all(f"About {x}." in text for x in "abc") and "Its own" in text


@pytest.mark.parametrize("n,shared,generic", [(3, 2, True), (10, 3, True), (10, 2, False), (11, 3, False), (1, 1, False)])
def test_generic_threshold(spark, n, shared, generic):
    pages = [page(f"/a/{i}", description="same" if i < shared else f"own {i}") for i in range(n)]
    described = describe.describe_pages(spark.createDataFrame(pages, PAGE))
    assert (described.filter("index_description = 'same'").count() == 0) is generic


def test_flat_sites(spark):
    def sections(*pages):
        described = describe.describe_pages(spark.createDataFrame(list(pages), PAGE))
        return {r.url[len(HOST) + 8:]: r.index_section for r in described.collect()}

    home = lambda path: page(path, section="Home")
    assert sections(home("/"), home("/a"), home("/b")) == {"/": "", "/a": "", "/b": ""}
    assert sections(home("/")) == {"/": "Home"}
    assert sections(home("/home/docs"), home("/home/2024"), home("/x")) == {
        "/home/docs": "Documentation", "/home/2024": "Blog", "/x": "Home",
    }
    assert sections(home("/a"), page("/docs/x", section="Documentation")) == {
        "/a": "Home", "/docs/x": "Documentation",
    }


def test_flat_index_has_no_section_header(spark):
    built = products(spark, [page("/a", "A", "", "Home", fallback=""), page("/", "H", "", "Home", fallback="")])
    assert index(built) == (
        "# Harbour\n\n> Notes from the bay\n\n- [H](https://harbour.test/)\n- [A](https://harbour.test/a)\n"
    )


def test_full_bundle(spark):
    pages = [page("/b", "Page B", markdown="Content B"), page("/a", "Page A", markdown="Content A")]
    assert full(products(spark, pages)) == (
        "# Harbour\n\n> Notes from the bay\n\n---\n\n## Page A\n\nSource: https://harbour.test/a\n\nContent A\n\n"
        "---\n\n## Page B\n\nSource: https://harbour.test/b\n\nContent B\n"
    )


def test_json_listing(spark):
    pages = [page("/b", 'B "quoted" \\ é\n', "d", "Home"), page("/a", "A", "", "Docs")]
    built = products(spark, pages)
    expected = {
        "name": "Harbour",
        "description": "Notes from the bay",
        "url": "https://harbour.test",
        "pages": [
            {"url": "https://harbour.test/a", "title": "A", "description": "", "section": "Docs"},
            {"url": "https://harbour.test/b", "title": 'B "quoted" \\ é\n', "description": "d", "section": "Home"},
        ],
    }
    assert document(built.json(), assemble.full_order(), "text") == (
        json.dumps(expected, indent=2, ensure_ascii=False) + "\n"
    )


def test_site_header_comes_from_the_homepage(spark):
    pages = [page("/", "Home title", "Home words", "Home"), page("/x/y")]
    df = spark.createDataFrame(pages + [("www.other.org", "https://www.other.org/a", "t", "", "", "m", "Home")], PAGE)
    headers = describe.site_headers(describe.site_facts(describe.with_second_section(df)))
    found = {r.site: (r.name, r.description, r.base_url) for r in headers.collect()}
    assert found == {
        "harbour.test": ("Home title", "Home words", "https://harbour.test"),
        "www.other.org": ("Other", "", "https://www.other.org"),
    }


def test_summary_counts_own_sections(spark):
    built = products(spark, [page("/a", section="Home"), page("/b", section="Home")])
    row = built.summary().first()
    assert (row.n_pages, row.n_sections) == (2, 1)
    assert row.size_kb == round(len(index(built).encode()) / 1024, 1)


def test_chosen_products():
    assert chosen_products() == ("index",)
    assert chosen_products(full=True) == ("index", "full")
    assert chosen_products(full=True, json=True) == ("json",)


def _files(folder, site):
    parts = sorted(glob.glob(f"{folder}/site={site}/part-*"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_written_files_are_the_documents(spark, workspace, tmp_path):
    rows = [
        (i, "big.org" if i % 3 else f"s{i % 2}.org", f"https://big.org/docs/{i:03d}" if i % 3 else f"https://s{i % 2}.org/x/{i}",
         f"<title>T{i}</title><main><h1>T{i}</h1><p>Page number {i} has quite some text to be kept. Yes.</p></main>")
        for i in range(120)
    ]
    pages = spark.createDataFrame(rows, "page_id int, site string, url string, html string").repartition(5)
    built = index_captured_pages(pages, workspace)
    chunks = assemble.index_documents(built.index(), workspace, lines_per_chunk=9).collect()
    for folder, kwargs in (("a", {"full": True}), ("b", {"json": True})):
        built.write(f"{tmp_path}/{folder}", **kwargs)
    for site, n in (("big.org", 80), ("s0.org", 20), ("s1.org", 20)):
        text = _files(f"{tmp_path}/a/index", site)
        assert text.count("\n- [T") == n and text.startswith("# ")
        urls = [line.split("](")[1].split(")")[0] for line in text.split("\n") if line.startswith("- [")]
        assert urls == sorted(urls)
        assert text == "".join(r.text for r in sorted(chunks, key=lambda r: r.chunk) if r.site == site)
        assert _files(f"{tmp_path}/a/full", site).count("\n---\n") == n
        assert len(json.loads(_files(f"{tmp_path}/b/json", site))["pages"]) == n


def test_every_captured_page_is_kept_or_dropped_once(spark, workspace):
    text = "<title>T</title><main><p>Quite some text to be kept, more than fifty characters.</p></main>"
    rows = [
        (1, "a.org", "https://a.org/x/", text),
        (2, "a.org", "https://a.org/x?y", text),
        (3, "a.org", "https://a.org/y", "<p>no</p>"),
        (4, None, "nonsense", text),
        (5, "a.org", "https://a.org/x", text),
    ]
    pages = spark.createDataFrame(rows, "page_id int, site string, url string, html string")
    built = index_captured_pages(pages, workspace)
    assert [r.page_id for r in built.pages.collect()] == [5]
    assert sorted((r.url, r.skip_reason) for r in built.dropped.collect()) == [
        ("https://a.org/x/", "duplicate"),
        ("https://a.org/x?y", "duplicate"),
        ("https://a.org/y", "no title or description"),
        ("nonsense", "invalid url"),
    ]
