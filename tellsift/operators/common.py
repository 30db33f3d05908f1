"""Small plan helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are worked out once per row.

    A filter on an ordinary derived column is pushed below it and works the expression out a
    second time. A generator of one row keeps the filter above, without a shuffle.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def computed_struct(df: DataFrame, column: Column) -> DataFrame:
    """Add the fields of a costly struct, worked out once per row."""
    return df.select("*", F.inline(F.array(column)))


def hinted(small: DataFrame, limit: int = 100_000) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``limit`` narrow rows; joins on it give the same rows either way.

    Without the hint a join on a few keys deals all rows of the large side to as many tasks: adaptive execution goes back
    from a broadcast where most partitions of the small side are empty.
    """
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
