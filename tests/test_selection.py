"""Exact quantiles, mutual information, selection by it and rows put side by side, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tellsift.catalog import model_q, registry
from tellsift.operators import evaluate, frequency as FR, stages
from tellsift.operators.quantiles import exact_quantiles
from tellsift.operators.selection import mutual_information
from tellsift.sources.aligned import read_with_position, side_by_side


def test_exact_quantiles_of_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 1.0, rng.gauss(0, 1), 1e12 * rng.random(), -1e-9])) for _ in range(3000)]
    rows += [("one", 5.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.25, 0.5, 0.875, 1.0]
    for kind, method in (("cont", "linear"), ("disc", "inverted_cdf")):
        found = {(r.g, r.share): r.quantile for r in exact_quantiles(df, ["g"], "x", shares, kind).collect()}
        assert {g for g, _ in found} == {"a", "b", None, "one"}
        for (g, share), value in found.items():
            values = [x for k, x in rows if k == g]
            assert value == pytest.approx(np.quantile(values, share, method=method), rel=1e-12)
    with pytest.raises(ValueError):
        exact_quantiles(df, ["g"], "x", shares, "other")
    assert exact_quantiles(df.where("false"), ["g"], "x", shares).count() == 0


def test_quartiles_stay_exact_beyond_a_hundred_thousand_rows(spark):
    df = spark.range(300_000).select(F.col("id").alias("doc"), ((F.col("id") * 7919 % 300_007) / 3).alias("x"), F.lit(1).alias("flag"))
    row = evaluate.compare_features(df.drop("doc"), ["flag"]).first()
    values = np.sort(np.arange(300_000) * 7919 % 300_007 / 3)
    assert (row.q25, row.median, row.q75) == tuple(values[[74_999, 149_999, 224_999]])


def test_weights_stand_for_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 70), (1, 3.0, 20), (1, 9.0, 10), (1, 50.0, 0)], "k int, x double, n long")
    found = {r.share: r.quantile for r in exact_quantiles(df, ["k"], "x", [0.5, 0.75, 0.95, 1.0], "disc", "n").collect()}
    assert found == {0.5: 0.0, 0.75: 3.0, 0.95: 9.0, 1.0: 9.0}


def test_robust_scaler_counts_the_zeros_of_sparse_vectors(spark):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((400, 6)) < 0.6, rng.normal(size=(400, 6)), 0.0)
    dense[:, 4], dense[:, 5] = 0.0, 2.0
    rows = [(Vectors.sparse(6, [(j, v) for j, v in enumerate(r) if v]) if i % 2 else Vectors.dense(r),) for i, r in enumerate(dense.tolist())]
    spread = stages.quartile_ranges(spark.createDataFrame(rows, ["v"]), "v")
    assert spread == pytest.approx(np.subtract(*np.quantile(dense, [0.75, 0.25], axis=0)))


def brute_information(values, labels, bins):
    edges = {float(np.quantile(values, i / bins, method="inverted_cdf")) for i in range(1, bins)}
    places = [sum(e < v for e in edges) for v in values]
    n, both, x, y = len(values), Counter(zip(places, labels)), Counter(places), Counter(labels)
    return sum(c / n * math.log(c * n / (x[p] * y[k])) for (p, k), c in both.items())


def test_mutual_information(spark):
    rng = random.Random(8)
    labels = [rng.choice([0, 1, 1]) for _ in range(600)]
    columns = {
        "noise": [rng.choice([0, 0, 0, 1, 2]) for _ in labels], "same": [float(k) for k in labels], "rare": [3.0 if i == 5 else 0.0 for i in range(600)],
        "mixed": [k + rng.gauss(0, 1) for k in labels], "below": [-rng.random() if rng.random() < 0.4 else 0.0 for _ in labels],
    }
    cells = [(name, float(v), labels[i]) for name, column in columns.items() for i, v in enumerate(column) if v]
    cells = spark.createDataFrame(cells, "feature string, value double, label int")
    found = {r.feature: r.mi for r in mutual_information(cells, dict(Counter(labels)), 4).collect()}
    assert found == {k: pytest.approx(brute_information(v, labels, 4), abs=1e-12) for k, v in columns.items()}

    vectors = [(float(k), Vectors.sparse(5, [(j, float(c[i])) for j, c in enumerate(columns.values()) if c[i]])) for i, k in enumerate(labels)]
    df = spark.createDataFrame(vectors, ["label", "assembled"])
    model = stages.MutualInformationSelector(k=2).fit(df)
    assert model.getIndices() == [1, 3] and model.transform(df).first()["features"].size == 2


def test_rows_side_by_side(spark, tmp_path):
    left, right = str(tmp_path / "left"), str(tmp_path / "right")
    spark.range(0, 100, 1, 4).select(F.col("id").alias("a")).write.parquet(left)
    spark.range(0, 70, 1, 3).select((F.col("id") * 2).alias("b")).write.parquet(right)
    a, b = read_with_position(spark, left), read_with_position(spark, right)
    rows = sorted(side_by_side(a, b).collect(), key=lambda r: r.position)
    assert [(r.position, r.a, r.b) for r in rows] == [(i, i, 2 * i if i < 70 else None) for i in range(100)]
    assert [r.position for r in a.repartition(7).orderBy("a").collect()] == list(range(100))
    with pytest.raises(ValueError):
        side_by_side(a, a)


def test_few_keys_do_not_gather_the_rows(spark, monkeypatch):
    """The few intervals and edges are sent to the rows, with equal results where they are joined instead."""
    from tellsift.operators import quantiles, selection

    rng = random.Random(7)
    cells = spark.createDataFrame([(rng.choice("ab"), float(rng.randint(1, 900)), rng.choice("xy")) for _ in range(2000)], "feature string, value double, label string")
    sizes = {r["label"]: r["count"] for r in cells.groupBy("label").count().collect()}
    plans, kept = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def planned(df, limit=100_000):
            out = common.hinted(df, limit)
            plans.append(out._jdf.queryExecution().toString())
            return out

        from tellsift.operators import common
        for module in (quantiles, selection):
            monkeypatch.setattr(module, "hinted", planned)
        sent = sorted(map(tuple, mutual_information(cells, sizes).collect()))
        assert plans and all("ResolvedHint" in p or "broadcast" in p.lower() for p in plans)
        plans.clear()
        for module in (quantiles, selection):
            monkeypatch.setattr(module, "hinted", lambda df: common.hinted(df, 0))
        assert [(f, pytest.approx(x)) for f, x in sent] == sorted(map(tuple, mutual_information(cells, sizes).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_notices_are_dealt_to_many_tasks(spark, sf):
    from tellsift.catalog.registry import notices

    assert notices(spark, sf).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_words_and_sentences_are_counted_in_one_pass(spark):
    """The total is no second pass over the text; sentences without words, null ones and null words count as before."""
    rows = [(["a", "b", "a"], 1), (["a", None], 0), ([], 1), (None, None), (["c", None], 0)]
    table = spark.createDataFrame(rows, "words array<string>, y int")
    top = FR.top_words(table, F.col("words"), 3)
    assert [tuple(r) for r in top.collect()] == [("a", 600.0), (None, 400.0), ("b", 200.0)]
    compared = FR.compare_top_words(table, F.col("words"), ["y"], 1)
    assert {tuple(r) for r in compared.collect()} == {("a", 600.0, 1000.0, None), (None, None, None, 1000.0)}
    assert FR.top_words(table.where("y > 5"), F.col("words")).collect() == FR.compare_top_words(table.where("y > 5"), F.col("words"), ["y"]).collect() == []
    for df in (top, compared):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "subquery" not in plan and plan.count("LogicalRDD") == 1


def test_only_labelled_filings_are_cut_and_scored(spark, tmp_path):
    """Labels meet filings before these are cut; filings with several labels give a row for each, as the join of sentences does."""
    texts = [(1, "The board met. Sales grew with the year."), (2, "Not labelled at all. Never cut."), (3, None), (4, "One only.")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 1), (4, 0, None), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = model_q.evaluated(spark, str(tmp_path))
    scored = model_q.scored_sentences(spark, str(tmp_path)).select("idx", "pos", "proba").join(registry.labels(spark, str(tmp_path)), "idx")
    assert found.columns and Counter(map(tuple, found.select(scored.columns).collect())) == Counter(map(tuple, scored.collect()))
    assert found.count() == 5 and set(found.columns) == set(scored.columns)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join ")
