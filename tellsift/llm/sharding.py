"""Balanced contiguous shards by size: prefix sums over all rows from the totals of partitions.

Rows are dealt to partitions by range of their order and only that narrow table is written down.
The totals of the partitions, one row each, give every partition its offset; a running sum inside
each partition gives every row its place in the global sum. Shard i takes the rows whose first byte
lies in [i, i + 1) / shards of all bytes, so sizes differ by less than the largest row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tellsift.llm.common import cut_lineage, whole_row

OVERHEAD = 8


def text_size(text: Column, overhead: int = OVERHEAD) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def shard_by_size(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", rows: bool = False) -> DataFrame:
    """Assign every row to one of ``shards`` contiguous shards in order of ``key``.

    Returns ``key``, size, text_crc32, shard and slot (gapless from 0 in its shard); with ``rows``
    also the whole input row as the struct ``row``. Order: key (nulls first), crc32, size; rows equal in all three are
    interchangeable, and are dealt over many partitions however many they are. Null text: size 8,
    crc32 0. Empty text: the same. Empty table: no rows. Fewer rows than shards: some shards stay
    empty. A row larger than a shard's share leaves the shards it spans empty.
    """
    order = ["_key", "text_crc32", "size", "_tie"]
    narrow = df.select(
        F.col(key).alias("_key"),
        text_size(F.col(text)).alias("size"),
        text_crc32(F.col(text)).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
        *([whole_row(df).alias("row")] if rows else []),
    )
    dealt = cut_lineage(narrow.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.sum("size").alias("_bytes")).select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_before"),
        F.sum("_bytes").over(Window.partitionBy(F.lit(0))).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    placed = (
        dealt.withColumn("_upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_row", F.row_number().over(inside))
        .join(offsets, "_part")
        .withColumn("shard", F.expr(f"cast(((_before + _upto - size) * {shards}) div _total as int)"))
    )
    placed = cut_lineage(placed.drop("_total", "_before", "_upto"))
    firsts = placed.groupBy("shard", "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(
        "shard", "_part", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_slots")
    )
    return placed.join(firsts, ["shard", "_part"]).select(
        F.col("_key").alias(key), "size", "text_crc32", "shard",
        (F.col("_row") - F.col("_first") + F.col("_slots")).cast("long").alias("slot"),
        *(["row"] if rows else []),
    )


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id", text: str = "text") -> None:
    """Write whole rows as Parquet, one folder ``_shard=i`` per shard, its rows in order of slot."""
    placed = shard_by_size(df, shards, key, text, rows=True).select("row", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    pieces = placed.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    pieces.select("row.*", "_shard").write.partitionBy("_shard").parquet(path)
