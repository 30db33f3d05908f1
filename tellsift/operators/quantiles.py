"""Exact quantiles of many groups at once, by refining histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tellsift.operators.common import hinted
from tellsift.session import cut_lineage

BUCKETS = 1024


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, shares: list[float], kind: str = "cont", weight: str | None = None
) -> DataFrame:
    """``keys``, ``share`` and ``quantile`` for each group and share.

    ``cont`` interpolates between the two nearest values, ``disc`` takes the first value that at least the share of the
    rows doesn't exceed. ``weight`` names how many rows a row stands for. Null and NaN values are left out; a group
    without others has no row. Infinite values aren't supported.

    The wanted ranks of all groups are looked for together: each round cuts the interval of values that holds a rank into
    ``BUCKETS`` and goes on with the bucket of that rank, between its own least and greatest value, until these are equal.
    Rows are only counted, inside tasks first, so a group with most of the rows isn't sorted or gathered anywhere.
    """
    if kind not in ("cont", "disc"):
        raise ValueError(f"unknown kind {kind!r}")
    rows = df.select(
        F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n")
    ).where("_v IS NOT NULL AND NOT isnan(_v) AND _n > 0")
    ends = rows.groupBy("_k").agg(F.sum("_n").alias("_total"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    share = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    asked = cut_lineage(ends.select("_k", "_total", "_low", "_high", share))
    place = F.col("share") * (F.col("_total") - 1) if kind == "cont" else F.greatest(F.ceil(F.col("share") * F.col("_total")), F.lit(1)) - 1
    asked = asked.withColumns({"_first": F.floor(place), "_second": F.ceil(place), "_part": place - F.floor(place)})

    ranks = F.explode(F.array_distinct(F.array("_first", "_second"))).alias("_rank")
    targets = cut_lineage(asked.select("_k", ranks, "_low", "_high", F.lit(0).cast("long").alias("_below")).distinct())
    while not (still := targets.where("_low < _high")).isEmpty():
        intervals = hinted(cut_lineage(still.select("_k", "_low", "_high", "_below").distinct()))
        inside = rows.join(intervals, "_k").where("_v BETWEEN _low AND _high")
        bucket = F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * BUCKETS), F.lit(BUCKETS - 1))
        counted = inside.groupBy("_k", "_low", "_high", "_below", bucket.alias("_b")).agg(
            F.sum("_n").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most")
        )
        upto = F.col("_below") + F.sum("_n").over(Window.partitionBy("_k", "_low", "_high", "_below").orderBy("_b"))
        counted = counted.withColumn("_upto", upto)
        found = still.join(counted, ["_k", "_low", "_high", "_below"]).where("_rank < _upto AND _rank >= _upto - _n")
        found = found.select("_k", "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_upto") - F.col("_n")).alias("_below"))
        targets = cut_lineage(targets.where("_low = _high").unionByName(found))

    at = lambda name: targets.select("_k", F.col("_rank").alias(name), F.col("_low").alias(f"{name}_value"))
    out = asked.drop("_low", "_high").join(at("_first"), ["_k", "_first"]).join(at("_second"), ["_k", "_second"])
    quantile = F.col("_first_value") + F.col("_part") * (F.col("_second_value") - F.col("_first_value"))
    return out.select("_k.*", "share", quantile.alias("quantile"))
