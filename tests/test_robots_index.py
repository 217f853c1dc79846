import duckdb
import pytest
from pyspark.sql import functions as F

from sitequarry.operators import robots
from sitequarry.operators.robots_index import indexed_verdicts, robots_indexed

ROBOTS = """User-agent: *
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Disallow: /a*b*c
Allow: /
Disallow: *secret
Disallow: /exact$

User-agent: other
Disallow: /
"""


@pytest.fixture
def rules(spark):
    captures = spark.createDataFrame(
        [("x.com", 200, ROBOTS), ("y.com", 404, "Disallow: /"), ("z.com", 200, "User-agent: *\nDisallow: /\n")],
        "site string, status int, body string",
    )
    return robots.robots_rules(robots.robots_directives(captures))


PATHS = [
    "/private",
    "/private/x",
    "/private/open/doc",
    "/file.pdf",
    "/file.pdf?x",
    "/aXbYc",
    "/acb",
    "/top/secret/x",
    "/exact",
    "/exact/more",
    "/",
    "",
    None,
    "/naïve",
]


def plain_verdicts(spark, rules, pages):
    """The unindexed form: every rule of a site tried on every page."""
    joined = pages.join(robots.site_rules(rules), "site", "left")
    return {
        (r["page_id"]): r["allowed"]
        for r in joined.select("page_id", robots.robots_allow(F.col("path"), F.col("rules")).alias("allowed")).collect()
    }


def test_index_equals_every_rule_tried(spark, rules):
    rows = [(i * 3 + k, site, p) for i, p in enumerate(PATHS) for k, site in enumerate(["x.com", "y.com", "z.com"])]
    rows += [(1000, "w.com", "/private"), (1001, "x.com", "/private")]
    pages = spark.createDataFrame(rows, "page_id long, site string, path string")
    got = {r["page_id"]: r["allowed"] for r in robots_indexed(pages, rules).collect()}
    assert len(got) == len(rows)
    assert got == plain_verdicts(spark, rules, pages)
    assert got[1001] is False and got[1000] is True


def test_candidates_only(spark, rules):
    """A path meets only rules whose literal prefix it starts with."""
    pages = spark.createDataFrame([("x.com", "/private/open/doc")], "site string, path string")
    got = indexed_verdicts(pages, rules).collect()
    assert [(r["path"], r["allowed"]) for r in got] == [("/private/open/doc", True)]


def test_empty_tables(spark, rules):
    pages = spark.createDataFrame([], "page_id long, site string, path string")
    assert robots_indexed(pages, rules).count() == 0
    none = rules.limit(0)
    pages = spark.createDataFrame([(1, "x.com", "/private")], "page_id long, site string, path string")
    assert [r["allowed"] for r in robots_indexed(pages, none).collect()] == [True]


def test_query_equals_robots_allowed(spark):
    from sitequarry.plans.queries import QUERIES

    indexed = {tuple(r) for r in QUERIES["robots_indexed"](spark, "/root/testdata/sf0.001").collect()}
    plain = {tuple(r) for r in QUERIES["robots_allowed"](spark, "/root/testdata/sf0.001").collect()}
    assert indexed == plain and indexed
