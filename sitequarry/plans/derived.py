"""Inputs the given tables do not hold directly, derived from them by Spark.

Every table here grows with its source.  Texts are put together per row, or from groups
whose size is fixed by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions.urls import hostname

SHOP_SIZE = 500
#: Rows of a table from which one task makes pages.
ROWS_PER_TASK = 5_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows become pages, over as many tasks as its row count asks for.

    Rows are far smaller than their pages: a file that is one split would be parsed in one task.
    """
    rows = table(spark, sf_dir, name)
    return rows.repartition(rows.count() // ROWS_PER_TASK + 1)


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, variant, url): page URLs as they are, and with the forms they lack."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    origin = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    n = F.col("page_id").cast("string")
    variants = F.array(
        F.col("url"),
        F.concat(origin, F.lit("/docs/index.html?x="), n),
        F.concat(origin, F.lit("/a"), n, F.lit(".php/#f")),
        F.concat(F.upper(origin), F.lit(":8080/B/"), n, F.lit(".htm")),
        F.concat(origin, F.lit("?q="), n),
        F.concat(origin, F.lit("/x/"), n, F.lit("/index.php/")),
    )
    return pages.select("page_id", F.posexplode(variants).alias("variant", "url"))


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a description and an image; a site per nation."""
    customers = table(spark, sf_dir, "customer")
    html = F.concat(
        F.lit("<html><head><title> "), F.col("c_name"),
        F.lit(' </title><meta name="description" content=" '), F.col("c_mktsegment"),
        F.lit(' &amp; more "><meta property="og:description" content="unused"></head><body><main>'),
        F.lit("<h1>"), F.col("c_name"), F.lit("</h1><p>Customer "), F.col("c_custkey").cast("string"),
        F.lit(' <img src="a.png" alt="photo"> belongs to the segment <em>'), F.col("c_mktsegment"),
        F.lit("</em> and buys things.</p></main></body></html>"),
    )
    site = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit(".example.com"))
    return customers.select(
        "c_custkey",
        site.alias("site"),
        F.concat(F.lit("https://"), site, F.lit("/c/"), F.col("c_custkey").cast("string")).alias("url"),
        html.alias("html"),
    )


def _shop(key: Column) -> tuple[Column, Column, Column]:
    shop = F.floor(key / SHOP_SIZE).cast("int")
    host = F.concat(F.lit("shop"), shop.cast("string"), F.lit(".example.com"))
    return shop, (key % SHOP_SIZE).cast("int"), host


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shops of 500 customer pages; page k links to pages 6k+1 to 6k+6, back and elsewhere."""
    _, k, host = _shop(F.col("c_custkey"))

    def child(j: Column) -> Column:
        c = F.col("k") * 6 + j
        form = (
            F.when(c % 5 == 0, F.concat(F.lit("?ref="), F.col("k").cast("string")))
            .when(c % 5 == 1, F.lit("#top"))
            .when(c % 5 == 2, F.lit(".html"))
            .otherwise(F.lit(""))
        )
        return F.concat(F.lit('<a href="/c/'), c.cast("string"), form, F.lit('">next</a>'))

    children = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(6)), child), " ")
    own = F.when(F.col("k") == 0, F.lit("/")).otherwise(
        F.concat(
            F.lit("/c/"),
            F.col("k").cast("string"),
            F.when(F.col("k") % 7 == 3, F.lit(".html")).otherwise(F.lit("")),
        )
    )
    describe = F.when(F.col("k") % 3 == 0, F.lit("Customer page")).otherwise(F.col("c_mktsegment"))
    html = F.concat(
        F.lit('<!DOCTYPE html><html lang="en-US"><head><title>'), F.col("c_name"),
        F.lit('</title><meta name="description" content="'), describe,
        F.lit('"></head><body><main><h1>'), F.col("c_name"),
        F.lit("</h1><p>This customer has a balance of "), F.col("c_acctbal").cast("string"),
        F.lit(" and buys many things. It is a good customer.</p><p>"), children,
        F.lit(' <a href="/">home</a> <a href="https://other.example.org/x">other</a> '),
        F.lit('<a href="mailto:a@b.c">mail</a> <a href="/private/'), F.col("k").cast("string"),
        F.lit('">private</a></p></main></body></html>'),
    )
    return (
        spread_table(spark, sf_dir, "customer")
        .withColumns({"k": k, "site": host})
        .select(
            F.col("c_custkey").alias("page_id"),
            "site",
            F.concat(F.lit("https://"), F.col("site"), own).alias("url"),
            html.alias("html"),
        )
    )


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shop, host) of ``shop_pages``."""
    shop, _, host = _shop(F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select(shop.alias("shop"), host.alias("host")).distinct()


def shop_sites(spark: SparkSession, sf_dir: str, capped: bool = False) -> DataFrame:
    cap = F.col("shop") + 40 if capped else F.lit(0)
    return shops(spark, sf_dir).select(
        F.col("host").alias("base_url"),
        F.when(F.col("shop") % 2 == 0, F.lit(3)).otherwise(F.lit(2)).alias("depth"),
        cap.alias("max_pages"),
        F.lit(6 if capped else 0).alias("max_sitemap_urls"),
    )


def listed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site per customer: good ones, bad URLs, second rows for a host, and patterns that do not compile."""
    n = F.col("c_custkey")
    host = F.concat(F.lit("s"), (n - F.when(n % 5 == 1, 1).otherwise(0)).cast("string"), F.lit(".example.com"))
    return table(spark, sf_dir, "customer").select(
        F.when(n % 5 == 2, F.concat(F.lit("http://bad host "), n.cast("string"), F.lit("/x")))
        .when(n % 5 == 1, F.concat(host, F.lit("/second")))
        .otherwise(host)
        .alias("base_url"),
        F.array(F.when(n % 5 == 3, F.lit("/a(b")).otherwise(F.lit("/a(b)*"))).alias("exclude"),
    )


def fetched_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site for every hundred customers."""
    n = F.floor(F.col("c_custkey") / 100).cast("string")
    host = F.concat(F.lit("https://fetched"), n, F.lit(".example.com/"))
    return table(spark, sf_dir, "customer").select(host.alias("base_url"), F.lit(1).alias("depth")).distinct()


def page_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts for one page per customer, linked from the homepage of its site, which is customer 0 of the
    hundred: failed requests and retries before a good answer, and answers that are none."""
    customers = spread_table(spark, sf_dir, "customer")
    n, k = F.col("c_custkey"), F.col("c_custkey") % 100
    site = F.concat(F.lit("https://fetched"), F.floor(n / 100).cast("string"), F.lit(".example.com"))
    links = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.lit(99)),
            lambda i: F.concat(F.lit('<a href="/c/'), i.cast("string"), F.lit('">c</a>')),
        ),
        " ",
    )
    prose = F.concat(
        F.lit("<title>"), F.col("c_name"), F.lit("</title><main><p>This customer buys many things and pays for "
        "them in good time.</p></main>"),
    )
    case = F.when(k == 0, 0).otherwise(k % 8)
    body = (
        F.when(case == 3, F.lit("%PDF-1.7"))
        .when(case == 4, F.concat(prose, F.repeat(F.lit("x"), 10_000)))
        .when(case == 5, F.lit(""))
        .otherwise(prose)
    )
    good = F.struct(
        F.lit(2).alias("attempt"),
        F.when(case == 1, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(case == 2, F.lit("text/css")).otherwise(F.lit("text/html")).alias("content_type"),
        F.when(case == 6, F.lit(50_000)).cast("long").alias("content_length"),
        body.alias("body"),
    )
    failed = F.struct(
        F.lit(1).alias("attempt"),
        F.when(n % 2 == 0, F.lit(503)).alias("status"),
        F.lit(None).cast("string").alias("content_type"),
        F.lit(None).cast("long").alias("content_length"),
        F.lit(None).cast("string").alias("body"),
    )
    home = F.struct(
        F.lit(2).alias("attempt"),
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("long").alias("content_length"),
        F.lit("").alias("body"),
    )
    rows = customers.select(
        F.concat(site, F.when(k == 0, F.lit("/")).otherwise(F.concat(F.lit("/c/"), k.cast("string")))).alias("url"),
        F.explode(F.array(failed, F.when(k == 0, home).otherwise(good))).alias("f"),
        F.concat(F.lit("<title>Home</title><main><p>All customers of this part of the company are listed below.</p></main>"), links).alias("home"),
        k.alias("k"),
    ).select("url", "f.*", "home", "k")
    return rows.withColumn(
        "body", F.when((F.col("k") == 0) & (F.col("attempt") == 2), F.col("home")).otherwise(F.col("body"))
    ).drop("home", "k")


def shop_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = (
        "User-agent: *\nDisallow: /private/\nDisallow: /c/13\nAllow: /c/131\n"
        "Sitemap: /sm/index.xml\n"
    )
    return shops(spark, sf_dir).select(
        F.col("host").alias("site"), F.lit(200).alias("status"), F.lit(body).alias("body")
    )


def shop_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index per shop, naming itself, a missing sitemap and one with every 45th page."""
    origin = F.concat(F.lit("https://"), F.col("host"))
    index = F.concat(
        F.lit("<sitemapindex><loc> "), origin, F.lit("/sm/a.xml </loc><loc>"), origin,
        F.lit("/sm/index.xml</loc><loc>"), origin, F.lit("/sm/gone.xml</loc></sitemapindex>"),
    )
    tops = shops(spark, sf_dir).select(
        F.concat(origin, F.lit("/sm/index.xml")).alias("sitemap_url"), index.alias("xml")
    )
    _, k, host = _shop(F.col("c_custkey"))
    listed = (
        table(spark, sf_dir, "customer")
        .select(k.alias("k"), host.alias("host"))
        .filter("k % 45 = 5")
        .groupBy("host")  # at most 11 pages of a shop
        .agg(F.array_sort(F.collect_list("k")).alias("ks"))
    )
    loc = lambda c: F.concat(
        F.lit("<loc>"), origin, F.lit("/c/"), c.cast("string"), F.lit("?a=1&amp;b=2</loc>\n")
    )
    pages = listed.select(
        F.concat(origin, F.lit("/sm/a.xml")).alias("sitemap_url"),
        F.concat(
            F.lit("<urlset>"), F.array_join(F.transform("ks", loc), ""),
            F.lit("<loc>"), origin, F.lit("/a/b/c/d/e/f</loc><loc>"), origin,
            F.lit("/</loc><loc>"), origin, F.lit("/de/x</loc></urlset>"),
        ).alias("xml"),
    )
    return tops.unionByName(pages).select("sitemap_url", F.lit(200).alias("status"), "xml")


def supplier_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogues of 40 suppliers: an index and four parts of ten, each naming the next part first."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    site_no = F.floor(F.col("s_suppkey") / 40).cast("int")
    part_no = F.floor(F.col("s_suppkey") / 10).cast("int")
    origin = F.concat(F.lit("https://cat"), F.col("site_no").cast("string"), F.lit(".example.com"))
    parts = (
        suppliers.select("s_suppkey", site_no.alias("site_no"), part_no.alias("part_no"))
        .groupBy("site_no", "part_no")  # ten suppliers each
        .agg(F.array_sort(F.collect_list("s_suppkey")).alias("keys"))
    )
    loc = lambda c: F.concat(
        F.lit("<url><loc>"), origin, F.lit("/s/"), c.cast("string"), F.lit("?a=1&amp;b=2</loc></url>\n")
    )
    files = parts.select(
        F.concat(origin, F.lit("/sm/part"), F.col("part_no").cast("string"), F.lit(".xml")).alias(
            "sitemap_url"
        ),
        F.when(F.col("part_no") % 7 == 6, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.concat(
            F.lit("<urlset><loc>"), origin, F.lit("/sm/part"),
            (F.col("part_no") + 1).cast("string"), F.lit(".xml</loc>"),
            F.array_join(F.transform("keys", loc), ""),
            F.lit("<loc>\nnot on one line\n</loc></urlset>"),
        ).alias("xml"),
    )
    names = lambda p: F.concat(
        F.lit("<loc> "), origin, F.lit("/sm/part"), p.cast("string"), F.lit(".xml </loc>")
    )
    tops = (
        parts.groupBy("site_no")  # four parts each
        .agg(F.array_sort(F.collect_list("part_no")).alias("nos"))
        .select(
            F.concat(origin, F.lit("/sitemap.xml")).alias("sitemap_url"),
            F.lit(200).alias("status"),
            F.concat(
                F.lit("<sitemapindex>"), F.array_join(F.transform("nos", names), ""),
                F.lit("<loc>"), origin, F.lit("/sitemap.xml</loc><loc>"), origin,
                F.lit("/start/a/b/c/d</loc><loc>"), origin, F.lit("/de/start</loc><loc>"), origin,
                F.lit("/</loc></sitemapindex>"),
            ).alias("xml"),
        )
    )
    return tops.unionByName(files)


def supplier_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    site_no = F.floor(F.col("s_suppkey") / 40).cast("int")
    return (
        table(spark, sf_dir, "supplier")
        .select(site_no.alias("n"))
        .distinct()
        .select(
            F.concat(F.lit("https://cat"), F.col("n").cast("string"), F.lit(".example.com")).alias(
                "base_url"
            ),
            F.lit(3).alias("depth"),
            F.when(F.col("n") % 2 == 0, F.lit(20)).otherwise(F.lit(0)).alias("max_pages"),
            F.lit("EN").alias("lang"),
        )
    )


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(hostname(F.col("url")).alias("site")).distinct()


def host_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """robots.txt of the page hosts in four kinds; every fourth kind of host has none."""
    kind = F.length("site") % 4
    hosts = page_hosts(spark, sf_dir).withColumn("kind", kind).filter("kind < 3")
    body = (
        F.when(
            F.col("kind") == 0,
            F.concat(
                F.lit("User-agent: *\nDisallow: /en/1\nAllow: /en/12\nDisallow: /fr/\n"),
                F.lit("Allow: /fr/\nsitemap: /maps/"), F.col("site"), F.lit(".xml\n"),
            ),
        )
        .when(
            F.col("kind") == 1,
            F.concat(
                F.lit("User-Agent: other\nDisallow: /\n\nuser-agent: some\nUser-agent: *\n"),
                F.lit("Disallow: /***5$ # no fives\nAllow: /*55$\nDisallow:\r\nSitemap: https://"),
                F.col("site"), F.lit("/s1.xml\nSitemap: s2.xml\n# Disallow: /\nCrawl-delay: 3\n"),
                F.lit("Disallow: /es\n"),
            ),
        )
        .otherwise(F.lit("User-agent: *\nDisallow: /"))
    )
    status = F.when(F.col("kind") == 2, F.lit(404)).otherwise(F.lit(200))
    return hosts.select("site", status.alias("status"), body.alias("body"))


def fetch_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fetch attempts per URL, read from events; a failed request has no status."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    status = (
        F.when(n % 13 == 0, F.lit(None))
        .when(F.col("event_type") == "error", F.lit(503))
        .when(F.col("event_type") == "purchase", F.lit(429))
        .when(F.col("event_type") == "view", F.lit(404))
        .otherwise(F.lit(200))
    )
    content_type = F.when(n % 5 == 0, F.lit("text/plain")).when(
        n % 5 != 1, F.lit("text/html; charset=utf-8")
    )
    body = (
        F.when(n % 7 == 0, F.lit("%PDF-1.4 ..."))
        .when(n % 7 == 1, F.lit("PK.."))
        .when(n % 7 == 2, F.lit(""))
        .otherwise(F.concat(F.lit("<html><body>"), F.col("props"), F.lit("</body></html>")))
    )
    url = F.concat(F.lit("https://fetch.example.com/"), F.floor(n / 3).cast("string"))
    return e.select(
        url.alias("url"),
        (n % 3 + 1).cast("int").alias("attempt"),
        status.alias("status"),
        content_type.alias("content_type"),
        F.when(n % 11 == 0, F.lit(20971520)).cast("long").alias("content_length"),
        body.alias("body"),
    )


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that fail extraction in every way, one way per order."""
    orders = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    prose = F.lit("<main><p>This order has been placed and will be delivered in due time.</p></main>")
    title = F.concat(F.lit("<title>Order "), n.cast("string"), F.lit("</title>"))
    cases = [
        F.concat(title, F.lit("<meta http-equiv='REFRESH' content='0'>"), prose),
        F.concat(F.lit("<title>Redirecting</title>"), prose),
        prose,
        F.concat(title, F.lit("<p>Loading</p>")),
        F.concat(title, F.lit("<nav>Only links here, one after the other, but no text at all.</nav>")),
        F.concat(title, F.lit("<main><p>Short</p></main><p>Text outside of the main element does not count as content.</p>")),
        F.concat(title, F.lit("<p>"), F.repeat(F.lit("x"), 5 * 1024 * 1024 + 1), F.lit("</p>")),
    ]
    html = F.concat(title, prose)
    for i, case in enumerate(cases[:-1]):
        html = F.when(n % 8 == i, case).otherwise(html)
    html = F.when(n % 30000 == 7, cases[-1]).otherwise(html)
    site = F.concat(F.lit("orders"), (F.col("o_custkey") % 10).cast("string"), F.lit(".example.com"))
    return orders.select(
        n.alias("page_id"),
        site.alias("site"),
        F.concat(F.lit("https://"), site, F.lit("/o/"), n.cast("string")).alias("url"),
        html.alias("html"),
    )


def flat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, url, kind): flat sites, ``/home/…`` sites, ordinary sites and bare homepages."""
    parts = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    group = F.floor(n / 50).cast("int")
    kind = (group % 4).cast("int")
    site = F.concat(F.lit("flat"), group.cast("string"), F.lit(".example.com"))
    slug = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    path = (
        F.when(n % 50 == 0, F.lit("/"))
        .when(kind == 0, F.concat(F.lit("/"), n.cast("string")))
        .when(kind == 1, F.concat(F.lit("/home/"), slug, F.lit("/"), n.cast("string")))
        .otherwise(F.concat(F.lit("/"), F.lower("p_type"), F.lit("/"), n.cast("string")))
    )
    # A site of the last kind has its homepage alone; its other parts are homepages of their own.
    own = F.when(
        (F.col("kind") == 3) & (n % 50 != 0),
        F.concat(F.lit("flat-"), n.cast("string"), F.lit(".example.com")),
    ).otherwise(F.col("site"))
    path = F.when(F.col("kind") == 3, F.lit("/")).otherwise(path)
    return (
        parts.withColumns({"kind": kind, "site": site})
        .withColumns({"site": own, "path": path})
        .select("site", F.concat(F.lit("https://"), "site", "path").alias("url"), "kind")
    )


def locale_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, site, url): each part page in three copies, two with a locale prefix."""
    parts = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    site = F.concat(
        F.lit("parts"), F.floor(n / 200).cast("string"), F.lit(".example.com")
    )
    prefix = F.array(F.lit("/en/x/"), F.lit("/x/"), F.lit("/de/x/"))
    return parts.select(
        n, site.alias("site"), F.posexplode(prefix).alias("copy", "prefix")
    ).select(
        (n * 3 + F.col("copy")).alias("page_id"),
        "site",
        F.concat(F.lit("https://"), F.col("site"), F.col("prefix"), n.cast("string")).alias("url"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, blocks): document lines as text blocks; words with ``th`` count as linked."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = lambda line: F.filter(F.split(line, r"[ \t]+", -1), lambda w: w != "")

    def block(line: Column) -> Column:
        return F.struct(
            F.size(words(line)).alias("n_words"),
            F.size(F.filter(words(line), lambda w: F.contains(w, F.lit("th")))).alias("link_words"),
        )

    return docs.select("doc_id", F.transform(F.split("text", "\n", -1), block).alias("blocks"))
