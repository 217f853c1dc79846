"""Reading the input tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.functions.urls import ensure_scheme, hostname

# Options of a site that leaves them out.
DEFAULT_DEPTH = 3
DEFAULT_MAX_PAGES = 0
DEFAULT_MAX_SITEMAP_URLS = 0
DEFAULT_MIN_CONTENT = 50


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages (page_id, url, html) with ``site``, the host of the URL.

    URLs that cannot be parsed keep a NULL site; ``admission.invalid_urls`` reports them.
    """
    return spark.read.parquet(path).withColumn("site", hostname(F.col("url")))


def read_html_files(spark: SparkSession, path: str, base_url: str) -> DataFrame:
    """A folder of HTML files as pages; the path below ``path`` becomes the URL path.

    ``page_id`` is a hash of the URL.  Escaped characters of a path stay escaped, as in a URL.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Both as Spark and the file system write them, but for the slashes after the scheme.
    prefix = re.sub("^file:/+", "file:/", system.makeQualified(root).toUri().toString())
    whole = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    relative = F.substr(whole, F.lit(len(prefix.rstrip("/")) + 2))
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), relative)
    return files.select(
        F.xxhash64(url).alias("page_id"),
        hostname(url).alias("site"),
        url.alias("url"),
        F.col("value").alias("html"),
    )


def complete_sites(sites: DataFrame) -> DataFrame:
    """The site list with defaults filled in and the scheme added.

    Only ``base_url`` is needed; ``depth``, ``max_pages``, ``max_sitemap_urls``, ``lang``,
    ``include``, ``exclude`` and ``min_content_length`` are optional columns.
    """

    def optional(name: str, kind: str, default):
        given = F.col(name) if name in sites.columns else F.lit(None)
        return F.coalesce(given.cast(kind), default).alias(name)

    base = ensure_scheme(F.col("base_url"))
    none = F.array().cast("array<string>")
    return sites.select(
        hostname(base).alias("site"),
        base.alias("base_url"),
        optional("depth", "int", F.lit(DEFAULT_DEPTH)),
        optional("max_pages", "int", F.lit(DEFAULT_MAX_PAGES)),
        optional("max_sitemap_urls", "int", F.lit(DEFAULT_MAX_SITEMAP_URLS)),
        F.lower(optional("lang", "string", F.lit(None).cast("string"))).alias("lang"),
        optional("include", "array<string>", none),
        optional("exclude", "array<string>", none),
        optional("min_content_length", "int", F.lit(DEFAULT_MIN_CONTENT)),
    )
