"""Mix sources to target weights: capped water-filling, then whole and fractional repetitions.

The targets come from a table of one row per source. A document is repeated ``floor(target / size of
the source)`` times; the fraction that is left is met by taking the source's documents once more in
a seeded order until their sizes reach it. The running sum goes over stretches of that order, many
to a large source, so a source with a third of all rows is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tellsift.llm.common import cut_lineage, hinted, n_words, whole_row

STRETCH_ROWS = 1_000


def source_targets(sizes: DataFrame, source: str, cap: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``source_size`` and ``target`` to a table of one row per source with its ``size``.

    Sources in code-point order, null last, weigh ``weights`` in turn. The targets share out the sum
    of all sizes; none exceeds ``cap`` times its source's size. Filling level by level stops where no
    target is above its cap: sources in order of cap per weight are capped while their share of what
    the earlier ones left is larger than their cap. A source of size 0 gets 0.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_weight", turn.cast("long")).withColumn("_cap", F.col("size") * cap)
    level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    earlier, whole = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum("size").over(whole) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    weight = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(earlier), F.lit(0))
    steps = ranked.select("*", left.alias("_left"), weight.alias("_left_weight")).withColumn(
        "_capped", F.col("_cap") * F.col("_left_weight") <= F.col("_left") * F.col("_weight")
    )
    free = steps.select(
        "*",
        F.min(F.when(~F.col("_capped"), F.struct("_left_weight", "_left"))).over(whole).alias("_none"),
        F.max(F.when(~F.col("_capped"), F.struct("_left_weight", "_left"))).over(whole).alias("_free"),
    )
    share = F.col("_weight").cast("double") * F.col("_free._left").cast("double") / F.col("_free._left_weight").cast("double")
    return free.select(
        source, F.col("size").alias("source_size"),
        F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(share).alias("target"), "_rows", "_rank",
    )


def mix_sources(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: int = 3,
    weights: tuple[int, ...] = (1, 2, 3), seed: int = 2021, rows: bool = False,
) -> DataFrame:
    """How often the mix takes each row: ``copies``, with size, source_size, target and taken words.

    Size: words of the text; null or blank text: 0. The order within a source is md5 of key and seed,
    then key, size and crc32 of the text; rows equal in all of them are interchangeable. A source's
    taken words differ from its target by at most half a document. A null key is ordered as the empty
    string, a null source is a source of its own. Empty table: no rows. With ``rows`` the whole input
    row comes as the struct ``row``.
    """
    sized = df.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
        F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")).alias("_order"),
        *([whole_row(df).alias("row")] if rows else []),
    )
    totals = sized.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("_rows"))
    targets = cut_lineage(source_targets(totals, "_source", cap, weights).select(
        F.col("_source").alias("_of"), "_rank", "source_size", "target",
        F.ceil(F.col("_rows") / STRETCH_ROWS).alias("_stretches"),
    ))
    place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    cut = sized.join(hinted(targets), F.col("_source").eqNullSafe(F.col("_of"))).withColumn(
        "_stretch", F.floor(place * F.col("_stretches")).cast("long")
    )
    sums = cut.groupBy("_rank", "_stretch").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("_rank").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_rank", "_stretch",
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy("_rank", "_stretch").orderBy("_order", "_key", "size", "_crc").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = cut.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        offsets, ["_rank", "_stretch"]
    )
    whole = F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    middle = F.col("_before") + F.col("_inside") + F.col("size") / 2
    copies: Column = whole + F.when((middle < rest) & (F.col("size") > 0), 1).otherwise(0)
    return placed.select(
        F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
        *(["row"] if rows else []),
    )


def repeat_rows(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every column of ``df``, each row as often as the mix takes it."""
    taken = mix_sources(df, rows=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
