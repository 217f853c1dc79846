"""robots.txt bodies to rules and sitemap locations (S2, S5, G4, J1), after RFC 9309."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.urls import clean_path, href, resolve_href, url_parts


def robots_body(status: Column, body: Column) -> Column:
    """A missing or failed robots.txt is an empty policy."""
    return F.when(status.between(200, 299), F.coalesce(body, F.lit(""))).otherwise(F.lit(""))


def robots_directives(robots: DataFrame) -> DataFrame:
    """(site, line_no, directive, value) of the meaningful lines of (site, status, body).

    Of several captures for a site a successful one counts, then the one with the least text.
    """
    failed = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    place = Window.partitionBy("site").orderBy(failed, "body")
    one = robots.withColumn("_place", F.row_number().over(place)).filter("_place = 1")
    lines = one.select(
        "site",
        F.posexplode(
            F.split(robots_body(F.col("status"), F.col("body")), r"\r\n|\r|\n", -1)
        ).alias("line_no", "line"),
    )
    bare = F.regexp_replace("line", "^\\x{FEFF}|#.*$", "")
    pattern = r"(?s)^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$"
    return (
        lines.withColumn("line", bare)
        .select(
            "site",
            "line_no",
            F.lower(F.regexp_extract("line", pattern, 1)).alias("directive"),
            F.regexp_extract("line", pattern, 2).alias("value"),
        )
        .filter(F.col("directive").isin("user-agent", "allow", "disallow", "sitemap"))
    )


RULES = "array<struct<len:int,allow:boolean,pieces:array<string>,anchored:boolean>>"


def pattern_pieces(pattern: Column) -> tuple[Column, Column]:
    """What stands between the ``*`` of a robots path pattern, and whether its end is anchored.

    Runs of ``*`` count as one; a final one, also before ``$``, matches any end and is left out.
    """
    plain = F.regexp_replace(pattern, r"\*+(\$?)$", "")
    anchored = F.endswith(plain, F.lit("$"))
    body = F.when(anchored, F.left(plain, F.length(plain) - 1)).otherwise(plain)
    return F.split(body, r"\*+", -1), anchored


def path_matches(path: Column, pieces: Column, anchored: Column) -> Column:
    """A path starts with the first piece and holds the others after it in order.

    Each piece is looked for once, from where the one before it ended, so the work grows with the
    path and not with the number of ways to match it.
    """

    def after(position: Column, piece: Column) -> Column:
        found = F.position(piece, path, position)
        return F.when((position == 0) | (found == 0), 0).otherwise(found + F.length(piece))

    first = F.element_at(pieces, 1)
    start = F.when(F.startswith(path, first), F.length(first) + 1).otherwise(0)
    last = F.element_at(pieces, -1)
    n = F.size(pieces)
    middle = F.slice(pieces, 2, F.greatest(n - F.when(anchored, 2).otherwise(1), F.lit(0)))
    end = F.aggregate(middle, start, after)
    rest = F.length(path) - F.length(last) + 1
    return (
        F.when(~anchored, end > 0)
        .when(n == 1, path == first)
        .otherwise((end > 0) & (rest >= end) & F.endswith(path, last))
    )


def robots_rules(directives: DataFrame) -> DataFrame:
    """(site, line_no, allow, pattern, pieces, anchored, len) of the rules for every agent.

    Consecutive user-agent lines form one group with the rules that follow; only groups
    naming ``*`` count.  A window over a site sees the lines of one robots.txt, never more.
    """
    by_line = Window.partitionBy("site").orderBy("line_no")
    is_agent = F.col("directive") == "user-agent"
    starts = is_agent & (F.coalesce(F.lag("directive").over(by_line), F.lit("")) != "user-agent")
    grouped = (
        directives.filter(F.col("directive") != "sitemap")
        .withColumn("_starts", starts.cast("int"))
        .withColumn("_group", F.sum("_starts").over(by_line))
    )
    group = Window.partitionBy("site", "_group")
    pieces, anchored = pattern_pieces(clean_robots_path(F.col("value")))
    for_all = F.max((is_agent & (F.col("value") == "*")).cast("int")).over(group)
    return (
        grouped.withColumn("_for_all", for_all)
        .filter((F.col("_for_all") == 1) & (F.col("_group") > 0) & ~is_agent)
        .filter(F.col("value") != "")
        .select(
            "site",
            "line_no",
            (F.col("directive") == "allow").alias("allow"),
            F.col("value").alias("pattern"),
            pieces.alias("pieces"),
            anchored.alias("anchored"),
            F.length("value").alias("len"),
        )
    )


def clean_robots_path(pattern: Column) -> Column:
    """Percent-encode a pattern the way paths are, leaving plain patterns alone."""
    return F.when(pattern.rlike("[^\\x21-\\x7E]"), clean_path(pattern)).otherwise(pattern)


def site_rules(rules: DataFrame) -> DataFrame:
    """(site, rules ARRAY): the rules of a site in one row, as long as its robots.txt."""
    return rules.groupBy("site").agg(
        F.array_sort(
            F.collect_list(F.struct("len", "allow", "pieces", "anchored"))
        ).alias("rules")
    )


def robots_allow(path: Column, rules: Column) -> Column:
    """Longest matching rule decides, allow wins a tie, no match allows."""
    matching = F.filter(rules, lambda r: path_matches(path, r["pieces"], r["anchored"]))
    best = F.array_max(F.transform(matching, lambda r: F.struct(r["len"], r["allow"])))
    return F.coalesce(best["allow"], F.lit(True))


def sitemap_locations(sites: DataFrame, directives: DataFrame) -> DataFrame:
    """(site, pos, sitemap_url): sitemap lines resolved against the base, else /sitemap.xml."""
    named = (
        directives.filter((F.col("directive") == "sitemap") & (F.col("value") != ""))
        .groupBy("site")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("_named"))
    )
    base = url_parts(F.col("base_url"))
    with_base = sites.select("site", "base_url").join(named, "site", "left").withColumn("_b", base)
    query = F.regexp_extract(F.col("_line.value"), r"\?[^#]*", 0)
    target = href(resolve_href(F.col("_line.value"), F.col("_b")))
    fallback = F.array(F.struct(F.lit(0).alias("line_no"), F.lit("/sitemap.xml").alias("value")))
    return (
        with_base.select(
            "site", "_b", F.posexplode(F.coalesce("_named", fallback)).alias("pos", "_line")
        )
        .select("site", "pos", F.concat(target, query).alias("sitemap_url"))
        .filter(F.col("sitemap_url").isNotNull())
    )
