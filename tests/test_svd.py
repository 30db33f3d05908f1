"""Block subspace iteration against dense and brute-force results."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tellsift import session
from tellsift.operators import stages, svd, topics, vectorize as V
from tellsift.operators.frequency import token_grams


def matrix(found, columns):
    out = np.zeros((len(found.values), columns))
    for r in found.weights().collect():
        out[r.component, r.col] = r.weight
    return out


def table(spark, x):
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v], "row long, col long, value double")


@pytest.mark.parametrize("slices", [32, 3])
def test_against_dense(spark, monkeypatch, slices):
    monkeypatch.setattr(svd, "SLICE", slices)
    monkeypatch.setattr(svd, "BLOCK_CELLS", 100)
    monkeypatch.setattr(svd, "FAN", 2)
    rng = np.random.default_rng(3)
    x = rng.random((60, 25)) * (rng.random((60, 25)) < 0.4) * 0.7 ** np.arange(25)
    found = svd.leading(table(spark, x), 4, rounds=6)
    _, s, v = np.linalg.svd(x)
    assert np.allclose(found.values, s[:4]) and np.allclose(np.abs(matrix(found, 25) @ v[:4].T), np.eye(4), atol=1e-6)
    assert all(row[np.abs(row).argmax()] > 0 for row in matrix(found, 25))


def test_odd_cells(spark):
    schema = "row long, col string, value double"
    assert len(svd.leading(spark.createDataFrame([], schema), 3).values) == 0
    odd = [(1, "a", 2.0), (1, "a", 1.0), (2, "b", float("nan")), (2, "b", float("inf")), (None, "a", 5.0), (3, None, 5.0), (3, "b", None), (4, "b", 0.0)]
    found = svd.leading(spark.createDataFrame(odd, schema), 3)
    assert np.allclose(found.values, [3.0]) and [tuple(r) for r in found.weights().collect()] == [(0, "a", 1.0)]
    twice = svd.leading(spark.createDataFrame([(i, c, 1.0) for i in range(4) for c in "ab"], schema), 2)
    assert np.allclose(twice.values, [8**0.5])


def test_many_columns(spark):
    """Five planted directions among 200,000 columns: orthonormal, and each an eigenvector but for a small rest."""
    group = F.col("id") % 5
    core = spark.range(4000).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j")).select(
        "row", (F.col("row") % 5 * 10 + F.col("j")).alias("col"), (5.0 + F.col("row") % 5).alias("value")
    )
    rest = spark.range(4000).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("j"), group.alias("g")).select(
        "row", (50 + F.pmod(F.xxhash64("row", "j"), F.lit(200_000))).alias("col"), F.lit(0.5).alias("value")
    )
    cells = core.unionByName(rest).groupBy("row", "col").agg(F.sum("value").alias("value")).persist()
    assert cells.select("col").distinct().count() > 100_000
    found = svd.leading(cells, 5)
    weights = found.weights().persist()
    products = weights.alias("a").join(weights.alias("b"), "col").groupBy("a.component", "b.component").agg(F.sum(F.col("a.weight") * F.col("b.weight")))
    gram = np.zeros((5, 5))
    for i, j, x in products.collect():
        gram[i, j] = x
    assert np.allclose(gram, np.eye(5), atol=1e-10)
    image = cells.join(weights, "col").groupBy("row", "component").agg(F.sum(F.col("value") * F.col("weight")).alias("y"))
    back = cells.join(image, "row").groupBy("col", "component").agg(F.sum(F.col("value") * F.col("y")).alias("z"))
    sigma = F.array(*[F.lit(float(x)) for x in found.values])
    off = back.join(weights, ["col", "component"], "full").withColumn("s", F.get(sigma, F.col("component")))
    off = off.groupBy("component").agg(F.max("s").alias("s"), F.sqrt(F.sum((F.col("z") - F.col("s") * F.col("s") * F.col("weight")) ** 2)).alias("rest"))
    assert all(r.rest < 1e-6 * r.s**2 for r in off.collect())


def test_model_joins_beyond_its_limit(spark, monkeypatch):
    x = np.random.default_rng(1).random((20, 6))
    x[3] = 0
    rows = [(i, Vectors.sparse(6, {j: v for j, v in enumerate(r) if v})) for i, r in enumerate(x)] + [(20, Vectors.dense(x[0]))]
    df = spark.createDataFrame(rows, ["id", "scaled"])
    narrow = stages.TruncatedSvd(k=2).fit(df)
    monkeypatch.setattr(stages, "GRAM_COLUMNS", 0)
    model = stages.TruncatedSvd(k=2).fit(df)
    assert np.allclose(narrow.components, model.components, atol=1e-6)
    sent = [r.features.toArray() for r in model.transform(df).orderBy("id").collect()]
    monkeypatch.setattr(stages, "BROADCAST_CELLS", 0)
    joined = [r.features.toArray() for r in model.transform(df).orderBy("id").collect()]
    assert np.allclose(sent, joined) and np.allclose(sent[:20], x @ model.components.T) and np.allclose(sent[20], sent[0])


@pytest.mark.parametrize("scaler", ["l2", "maxabs", "std", "robust"])
def test_scaled_cells(spark, scaler):
    rng = np.random.default_rng(4)
    x = rng.random((12, 5)) * (rng.random((12, 5)) < 0.7)
    x[:, 4] = [3.0] + [0.0] * 11
    spread = {
        "l2": np.sqrt((x**2).sum(axis=1, keepdims=True)), "maxabs": x.max(axis=0), "std": x.std(axis=0),
        "robust": np.quantile(x, 0.75, axis=0) - np.quantile(x, 0.25, axis=0),
    }[scaler]
    got = np.zeros(x.shape)
    for r in topics.scaled_cells(table(spark, x), scaler, 12).collect():
        got[r.row, r.col] = r.value
    assert np.allclose(got, x / np.where(spread > 0, spread, 1))


def test_term_ids_and_lsa(spark):
    terms = [f"t{i * 7919 % 1000:04d}" for i in range(1000)] + ["", "é", "Z"]
    numbered = V.term_ids(spark.createDataFrame([(t,) for t in terms], "term string"), 7).collect()
    assert [r.term for r in sorted(numbered, key=lambda r: r.id)] == sorted(terms) and {r.id for r in numbered} == set(range(1003))
    assert V.term_ids(spark.createDataFrame([], "term string")).count() == 0
    texts = [(i, ["fish sea boat", "bank loan rate"][i % 2]) for i in range(10)]
    df = spark.createDataFrame(texts, "idx long, tokens string")
    weights, values = topics.lsa_topics(df, "idx", token_grams(F.col("tokens")), k=2)
    assert np.allclose(values, [5**0.5] * 2) and weights.count() == 12
    assert all(abs(w) < 1.0 for w in (r.weight for r in topics.rank_words(weights, 3).collect()))


def test_blocks_are_packed_rows(spark, monkeypatch):
    """A round reads a row per block, not one per cell; equal cells and columns that the basis lacks are kept apart."""
    monkeypatch.setattr(svd, "BLOCK_CELLS", 100)
    rng = np.random.default_rng(5)
    cells = [(f"r{i}", int(j), float(v)) for i in range(40) for j, v in zip(rng.integers(0, 30, 12), rng.random(12))]
    blocks = svd._blocks(spark.createDataFrame(cells, "row string, col long, value double")).collect()
    assert len(blocks) <= 5
    found = [
        (b["rows"][r], b["cols"][c], x)
        for b in blocks for r, c, x in zip(np.frombuffer(b["r"], "<i4"), np.frombuffer(b["c"], "<i4"), np.frombuffer(b["x"], "<f8"))
    ]
    assert sorted(found) == sorted(cells)
    basis = spark.createDataFrame([(j, [float(j), 1.0]) for j in range(0, 30, 2)], "col long, v array<double>")
    product = {r["row"]: r["v"] for r in svd.project(spark.createDataFrame(cells, "row string, col long, value double"), basis, 2).collect()}
    for row in {c[0] for c in cells}:
        even = [(j, x) for r, j, x in cells if r == row and j % 2 == 0]
        assert (row in product) == bool(even)
        if even:
            assert np.allclose(product[row], [sum(j * x for j, x in even), sum(x for _, x in even)])


def test_start_is_drawn_by_many_tasks(spark, monkeypatch):
    """The start's numbers cost much and its columns are few bytes, which adaptive execution puts into one task."""
    tasks = []
    kept = svd.written

    def watched(df):
        out = kept(df)
        if df.columns == ["col", "v"]:
            tasks.append(df.select(F.spark_partition_id()).distinct().count())
        return out

    monkeypatch.setattr(svd, "written", watched)
    found = svd.leading(table(spark, np.random.default_rng(3).random((30, 200))), 3)
    assert len(found.values) == 3 and tasks == [spark.sparkContext.defaultParallelism]


def test_terms_and_weights_sent_or_joined(spark, monkeypatch, tmp_path):
    """No string of the vocabulary and no attribute of a column is on the driver; terms and weights beyond a size are joined."""
    texts = [(1, ["a", "b", "a"], 1.0), (2, ["b", "c", "zz"], None), (3, [], 0.0), (4, None, 2.0), (5, ["c", "b"], 3.0)]
    df = spark.createDataFrame(texts, "id int, grams array<string>, x double")
    model = stages.TermCounter(minDF=2.0, maxDF=3.0).fit(df)
    assert sorted(model.vocabulary) == ["b", "c"] and stages.TermCounter(vocabSize=1).fit(df).vocabulary == ["b"]
    with pytest.raises(ValueError):
        stages.TermCounter(minDF=9.0).fit(df)

    def worked(model):
        counted = model.transform(df)
        idf = stages.SmoothIdf().fit(counted)
        idf.write().overwrite().save(str(tmp_path / "idf"))
        again = stages.ColumnWeights.load(str(tmp_path / "idf"))
        weighted = stages.Assembler(inputCol="weighted", columns=["x"]).transform(again.transform(counted))
        out = stages.MaxAbs().fit(weighted).transform(weighted)
        assert not any(f.metadata for f in out.schema.fields)
        return {r.id: (r.counts.toArray().tolist(), np.nan_to_num(r.scaled.toArray(), nan=-1).round(9).tolist()) for r in out.collect()}

    sent = worked(model)
    at = {t: i for i, t in enumerate(model.vocabulary)}
    assert [sent[i][0][at[t]] for i, t in ((1, "b"), (2, "b"), (2, "c"), (3, "b"), (4, "c"))] == [1, 1, 1, 0, 0]
    assert sent[2][1][-1] == -1  # NaN
    assert [sent[i][1][-1] for i in range(1, 6)] == [round(1 / 3, 9), -1, 0, round(2 / 3, 9), 1]
    model.write().overwrite().save(str(tmp_path / "terms"))
    assert worked(stages.TermCounterModel.load(str(tmp_path / "terms"))) == sent
    monkeypatch.setattr(stages, "BROADCAST_TERMS", 0)
    assert worked(stages.TermCounterModel.load(str(tmp_path / "terms"))) == sent


def test_blocks_write_no_copy_of_the_cells(spark, monkeypatch):
    """The cells were written as a table before they were packed, which took as much disk again."""
    monkeypatch.setattr(svd, "BLOCK_CELLS", 50)
    kept, tables = svd.written, []
    monkeypatch.setattr(svd, "written", lambda df: tables.append(df.columns) or kept(df))
    cells = [(i % 7, j, 1.0 + i) for i in range(21) for j in range(40)] + [(None, 1, 1.0), (1, None, 1.0), (2, 2, None), (3, 3, 0.0), (4, 4, float("nan"))]
    blocks = svd._blocks(spark.createDataFrame(cells, "row long, col long, value double")).collect()
    assert tables == [["block", "rows", "cols", "r", "c", "x"]] and len({b["block"] for b in blocks}) == len(blocks)
    # a row is in one block only
    assert sorted(r for b in blocks for r in b["rows"]) == list(range(7))
    assert sum(len(np.frombuffer(b["x"], "<f8")) for b in blocks) == 21 * 40


def test_unneeded_shuffles_are_swept(spark, monkeypatch):
    swept = []
    monkeypatch.setattr(session.gc, "collect", lambda: swept.append(1))
    monkeypatch.setattr(session, "_swept", session.time.monotonic() - 2 * session.SWEEP_S)
    assert session.written(spark.range(3)).count() == 3 and session.cut_lineage(spark.range(2)).count() == 2
    assert len(swept) == 1
