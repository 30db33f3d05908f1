"""Curves, thresholds, scores and error tables for scored rows."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from tellsift.operators.quantiles import exact_quantiles
from tellsift.session import cut_lineage


def cumulative(scored: DataFrame, score: str, label: str, buckets: int = 1024) -> DataFrame:
    """Per distinct score, from high to low: own and running positives and negatives.

    Rows of one score are added up first. The scores are then cut at their quantiles into
    buckets, summed up bucket by bucket, and moved by the totals of the buckets above, so that no
    window covers the whole table. ``next_pos`` and ``next_neg`` belong to the score below. The
    sums per score are stored first, so that the rows are scored once.
    """
    points = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    points = cut_lineage(points)
    probs = [i / buckets for i in range(1, buckets)]
    inner = sorted(set(points.approxQuantile("threshold", probs, 0.25 / buckets)))
    splits = [float("-inf"), *(inner or [0.5]), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="threshold", outputCol="bucket").transform(points)
    above = Window.orderBy(F.desc("bucket"))
    totals = cut.groupBy("bucket").agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.max_by(F.struct("pos", "neg"), "threshold").alias("first"),
    )
    offsets = totals.select(
        "bucket",
        (F.sum("p").over(above) - F.col("p")).alias("p0"),
        (F.sum("n").over(above) - F.col("n")).alias("n0"),
        F.lead("first").over(above).alias("below"),
        F.sum("p").over(Window.partitionBy()).alias("all_pos"),
        F.sum("n").over(Window.partitionBy()).alias("all_neg"),
    )
    inside = Window.partitionBy("bucket").orderBy(F.desc("threshold"))
    running = cut.select(
        "threshold",
        "pos",
        "neg",
        "bucket",
        F.sum("pos").over(inside).alias("tp"),
        F.sum("neg").over(inside).alias("fp"),
        F.lead(F.struct("pos", "neg")).over(inside).alias("next"),
    )
    # One row per bucket, so the size of this side is fixed.
    return running.join(F.broadcast(offsets), "bucket").select(
        "threshold",
        "pos",
        "neg",
        (F.col("tp") + F.col("p0")).alias("tp"),
        (F.col("fp") + F.col("n0")).alias("fp"),
        F.coalesce("next.pos", "below.pos").alias("next_pos"),
        F.coalesce("next.neg", "below.neg").alias("next_neg"),
        "all_pos",
        "all_neg",
    )


def pr_curve(points: DataFrame) -> DataFrame:
    """Precision and recall when rows at or above the threshold are positive; ends at (1, 0)."""
    curve = points.select(
        "threshold",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp"), F.col("all_pos")).alias("recall"),
    )
    end = points.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return curve.unionByName(end)


def roc_curve(points: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """True and false positive rates; starts at (0, 0) with an infinite threshold.

    A point is left out when the step to it equals the next step, as it lies on a straight line.
    """
    kept = points
    if drop_collinear:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        same = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        kept = points.where(first | F.col("next_pos").isNull() | ~same)
    curve = kept.select(
        "threshold",
        F.try_divide(F.col("tp"), F.col("all_pos")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("all_neg")).alias("fpr"),
    )
    start = points.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr")
    )
    return start.unionByName(curve)


def best_f1(points: DataFrame) -> DataFrame:
    """Threshold with the best F1; undefined F1 counts as 0; of equals the lowest threshold."""
    p, r = F.col("precision"), F.col("recall")
    scored = pr_curve(points).where("threshold is not null").select(
        "threshold", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")
    )
    return scored.orderBy(F.desc("f1"), F.asc("threshold")).limit(1)


def best_gmean(points: DataFrame, drop_collinear: bool = True) -> DataFrame:
    """Threshold with the best geometric mean of sensitivity and specificity; of equals the highest."""
    scored = roc_curve(points, drop_collinear).select(
        "threshold", F.sqrt(F.col("tpr") * (1 - F.col("fpr"))).alias("gmean")
    )
    return scored.orderBy(F.desc("gmean"), F.desc("threshold")).limit(1)


def areas(points: DataFrame) -> DataFrame:
    """Average precision as a step sum, and the area under the ROC curve."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return points.agg(
        F.sum(F.try_divide(F.col("pos"), F.col("all_pos")) * precision).alias("pr_auc"),
        F.sum(
            F.try_divide(F.col("neg"), F.col("all_neg"))
            * F.try_divide(F.col("tp") - F.col("pos") / 2, F.col("all_pos"))
        ).alias("roc_auc"),
    )


def apply_threshold(
    scored: DataFrame, threshold, score: str = "proba", out: str = "pred", inclusive: bool = False
) -> DataFrame:
    """1 where the score is above the threshold (or equal to it, with ``inclusive``)."""
    limit = F.lit(threshold)
    hit = F.col(score) >= limit if inclusive else F.col(score) > limit
    return scored.withColumn(out, hit.cast("int"))


def precision_recall_f1(
    predicted: DataFrame, label: str, pred: str = "pred", by: list[str] | None = None
) -> DataFrame:
    """Scores at a threshold, per group (such as train and test); empty denominators give 0."""
    truth, guess = F.col(label) == 1, F.col(pred) == 1
    counts = predicted.groupBy(*(by or [])).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
    )

    def share(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *(by or []),
        share(tp, tp + fp).alias("precision"),
        share(tp, tp + fn).alias("recall"),
        share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def prediction_errors(predicted: DataFrame, label: str, pred: str = "pred") -> DataFrame:
    """Rows whose prediction differs from the truth."""
    return predicted.where(F.col(pred) != F.col(label))


def no_skill(df: DataFrame, label: str) -> DataFrame:
    """Precision of a classifier that knows nothing: the share of positives."""
    return df.agg(F.avg((F.col(label) == 1).cast("double")).alias("no_skill"))


def compare_features(
    df: DataFrame, keys: list[str], features: list[str] | None = None
) -> DataFrame:
    """Distribution of every numeric feature by the value of every label. Quartiles are exact."""
    if features is None:
        features = [c for c, t in df.dtypes if t != "string" and c not in keys]
    long = (
        df.select(
            *[F.col(f).cast("double").alias(f) for f in features],
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"))
                        for k in keys
                    ]
                )
            ).alias("g"),
        )
        .select(*features, "g.key", "g.value")
        .unpivot(["key", "value"], features, "feature", "x")
    )
    long = cut_lineage(long)
    stats = long.groupBy("feature", "key", "value").agg(
        F.count("x").alias("rows"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"), F.min("x").alias("low"), F.max("x").alias("high")
    )
    found = exact_quantiles(long, ["feature", "key", "value"], "x", [0.25, 0.5, 0.75], "disc")
    at = lambda share, name: F.max(F.when(F.col("share") == share, F.col("quantile"))).alias(name)
    found = found.groupBy(F.struct("feature", "key", "value").alias("_g")).agg(at(0.25, "q25"), at(0.5, "median"), at(0.75, "q75"))
    return stats.withColumn("_g", F.struct("feature", "key", "value")).join(found, "_g", "left").select(
        "feature", "key", "value", "rows", "mean", "stddev", "low", "q25", "median", "q75", "high"
    )
