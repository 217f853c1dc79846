"""Columns that are evaluated exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace costly columns that later filters and projections use many times.

    The optimizer moves a filter below a projection by repeating the projected expressions
    in it, once per use.  It does not move one below a generator, so these come out of one.
    """
    once = F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, F.inline(once))
