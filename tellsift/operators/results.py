"""Tables of model results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def search_long(results: DataFrame, params: list[str]) -> DataFrame:
    """Train and validation scores against every parameter that varies, in long form.

    Score columns are named ``mean_train_{score}`` and ``mean_test_{score}``.
    """
    distinct = results.agg(*[F.countDistinct(F.col(p).cast("string")).alias(p) for p in params])
    row = distinct.first()
    varying = [p for p in params if row[p] > 1]
    scores = [c for c in results.columns if c.startswith(("mean_train_", "mean_test_"))]
    base = results.select(
        "model_name",
        *[F.col(p).cast("string").alias(p) for p in varying],
        *[F.col(s).cast("double").alias(s) for s in scores],
    )
    by_param = base.unpivot(["model_name", *scores], varying, "param", "value")
    long = by_param.unpivot(["model_name", "param", "value"], scores, "measure", "score")
    return long.select(
        "model_name",
        "param",
        "value",
        F.when(F.col("measure").startswith("mean_train_"), "train").otherwise("validation").alias("part"),
        F.regexp_replace("measure", "^mean_(?:train|test)_", "").alias("measure"),
        "score",
    )


def model_table(spark: SparkSession, summaries: list[dict]) -> DataFrame:
    """One row per model; columns are the union of the summaries' names."""
    names = sorted({k for s in summaries for k in s})
    number = {n: all(isinstance(s.get(n, 0.0), (int, float)) for s in summaries) for n in names}
    rows = [
        tuple(
            None if s.get(n) is None else float(s[n]) if number[n] else str(s[n]) for n in names
        )
        for s in summaries
    ]
    schema = ", ".join(f"`{n}` {'double' if number[n] else 'string'}" for n in names)
    return spark.createDataFrame(rows, schema)


def stack_summary(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """New model rows on top of earlier ones."""
    return new if old is None else new.unionByName(old, allowMissingColumns=True)
