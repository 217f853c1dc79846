"""Writing the products, in document order: as a table of lines, or one folder per site (K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

PRODUCTS = ("index", "full", "json")


def write_documents(rows: DataFrame, order: list[Column], text: str, path: str) -> None:
    """Write text rows so that the part files of a site, by name, are its document.

    One range-partitioned sort orders all sites at once; a large site simply spans
    several part files.
    """
    (
        rows.orderBy("site", *order)
        .select("site", text)
        .write.mode("overwrite")
        .partitionBy("site")
        .text(path)
    )


def write_document_table(rows: DataFrame, order: list[Column], text: str, path: str) -> None:
    """Write text rows of all sites as one table (site, text), range partitioned and sorted in
    document order; its number of files does not depend on the number of sites."""
    rows.orderBy("site", *order).select("site", text).write.mode("overwrite").parquet(path)


def chosen_products(full: bool = False, json: bool = False) -> tuple[str, ...]:
    """JSON stands in for the index and ends the run; the full bundle comes on top of it."""
    if json:
        return ("json",)
    return ("index", "full") if full else ("index",)
