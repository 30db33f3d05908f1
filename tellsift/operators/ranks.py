"""Ranks and running sums that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tellsift.session import written

# A window limit up to this many rows per group is applied by Spark before the shuffle.
GROUP_LIMIT = 1000
SALTS = 64


def order_key(seed: int, *columns: str) -> Column:
    """Seeded order of rows: md5 of the key columns and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def exact_rank(df: DataFrame, keys: list[str], hashed: str, ties: list[str]) -> DataFrame:
    """Add ``rank`` (from 1, by the hex string ``hashed``) and ``group_rows`` per ``keys``.

    Each group is cut into 4096 stretches by the first three hex digits. A stretch is ranked on
    its own and moved up by the number of rows in the stretches before it, so that a class with
    most of the rows is ranked by many tasks.
    """
    return _ranked(df.withColumn("_stretch", F.substring(hashed, 1, 3)), keys, [hashed, *ties])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with rows numbered from 1 per ``keys`` in the given order, in place of a column ``name`` if there is one.

    Rows are dealt by range of keys and order, so that a group with most rows is numbered by many tasks. They are
    written once, since Spark draws the bounds of ranges anew each time; only keys and order are ranked, the other
    columns meet their number by a row id, which spreads evenly.
    """
    dealt = df.repartitionByRange(*keys, *order).withColumn("_row", F.monotonically_increasing_id())
    cut = written(dealt.withColumn("_stretch", F.spark_partition_id()))
    ranked = _ranked(cut.select(*dict.fromkeys([*keys, *order]), "_row", "_stretch"), keys, order)
    whole = cut.join(ranked.select("_row", F.col("rank").alias("_rank")), "_row")
    return whole.withColumn(name, F.col("_rank")).select(*dict.fromkeys([*df.columns, name]))


def _ranked(cut: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``rank`` and ``group_rows``; ``_stretch`` says in which stretch of its group's order a row stands."""
    counts = cut.groupBy(*keys, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_stretch").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("group_rows"),
    )
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    ranked = cut.withColumn("_r", F.row_number().over(inside))
    match = F.col("_stretch") == F.col("_s")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranked.join(offsets, match).select(
        *[c for c in cut.columns if c != "_stretch"], (F.col("_r") + F.col("_before")).alias("rank"), "group_rows"
    )


def first_per_group(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """At most ``n`` rows per group in the given order.

    Small limits are cut before the shuffle by Spark itself. For larger ones each group is first
    cut within salted parts, so that a hot group is sorted by many tasks.
    """
    if n > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
        df = df.drop("_salt", "_r")
    whole = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= n).drop("_r")
