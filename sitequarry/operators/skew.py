"""Joins and numbering that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.operators.lineage import Workspace

ROWS_PER_SALT = 1_000_000


def hot_keys(counts: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more rows than one task should take, and over how many salts to spread them.

    ``counts`` is (key, n_rows).  There is at most one such key per ``rows_per_salt`` rows.
    """
    return counts.filter(F.col("n_rows") > rows_per_salt).select(
        key, F.ceil(F.col("n_rows") / rows_per_salt).cast("int").alias("_salts")
    )


def spread_join(
    big: DataFrame,
    small: DataFrame,
    key: str,
    spread_by: str,
    counts: DataFrame | None = None,
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``big`` with one row per ``key`` of ``small``, salting the hot keys of ``big``.

    Rows of a hot key are spread by the hash of ``spread_by`` and the matching row of
    ``small`` is repeated once per salt.  ``counts`` saves a pass when (key, n_rows) is known.
    """
    if counts is None:
        counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    hot = hot_keys(counts, key, rows_per_salt)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = (
        big.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread_by), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        small.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, [key, "_salt"], how).drop("_salt")


def number_rows(
    df: DataFrame, key: str, order: list[Column], workspace: Workspace, name: str = "position"
) -> DataFrame:
    """1-based position of each row within ``key``, by ``order``.

    A window over ``key`` would sort a hot key in one task.  Here the rows are range
    partitioned by key and order, numbered inside each partition, and shifted by the row
    counts of the earlier partitions of the same key.
    """
    ordered = (
        df.repartitionByRange(F.col(key), *order)
        .sortWithinPartitions(F.col(key), *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id())
    )
    table = workspace.table(ordered, "ordered")  # partition numbers must not change any more
    pieces = table.groupBy(key, "_part").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per range partition of a key: short however many rows the key has.
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = pieces.select(
        key,
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        table.join(shift, [key, "_part"])
        .withColumn(name, F.col("_row") + F.col("_shift") + 1)
        .drop("_part", "_row", "_shift")
    )
