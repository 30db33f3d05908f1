"""Ranks, curves, sources, models, self-training, topics and streaming."""

import random
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tellsift.catalog import all_queries, model_q
from tellsift.functions.rules import default_rules, read_rules, rule_table
from tellsift.operators import chunks, evaluate as EV, ranks, sampling, scoring, tables, topics
from tellsift.operators.frequency import token_grams
from tellsift.operators.stages import (
    ColumnScaler, LengthFeatures, PosFeatures, SentimentFeatures, SmoothIdf, SublinearTf, TruncatedSvd, max_share,
)
from tellsift.plans import explore, labelling, predict, selftrain, training
from tellsift.session import cut_lineage
from tellsift.sources import tables as SRC
from tellsift.streaming.incremental import pending, score_new_files


def test_exact_rank_with_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 < 9, "hot").otherwise(None).alias("g"))
    hashed = df.withColumn("h", ranks.order_key(3, "id"))
    rows = ranks.exact_rank(hashed, ["g"], "h", ["id"]).collect()
    for group in ("hot", None):
        mine = sorted((r for r in rows if r.g == group), key=lambda r: (r.h, r.id))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert {r.group_rows for r in mine} == {len(mine)}


@pytest.mark.parametrize("n", [3, 1500])
def test_first_per_group(spark, n):
    df = spark.range(6000).select((F.col("id") % 2).alias("g"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    got = ranks.first_per_group(df, ["g"], ["h", "id"], n).collect()
    want = [sorted((r for r in df.collect() if r.g == g), key=lambda r: r.h)[:n] for g in (0, 1)]
    assert {r.id for r in got} == {r.id for part in want for r in part}


def brute_curve(pairs):
    points = []
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(1 for s, y in pairs if s >= t and y == 1)
        fp = sum(1 for s, y in pairs if s >= t and y == 0)
        points.append((t, tp, fp))
    return points


@pytest.mark.parametrize("spread", [7, 100000])
def test_curve_against_brute_force(spark, spread):
    rng = random.Random(spread)
    pairs = [(rng.randrange(spread) / spread, int(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "s double, y int")
    points = EV.cumulative(df, "s", "y", buckets=16)
    got = sorted(((r.threshold, r.tp, r.fp) for r in points.collect()), reverse=True)
    assert got == brute_curve(pairs)
    positives = sum(y for _, y in pairs)
    concordant = sum(
        (a > b) + 0.5 * (a == b) for a, y in pairs if y == 1 for b, z in pairs if z == 0
    ) / (positives * (len(pairs) - positives))
    assert EV.areas(points).first().roc_auc == pytest.approx(concordant)


def test_average_precision_is_a_step_sum(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert EV.areas(EV.cumulative(df, "s", "y")).first().pr_auc == pytest.approx(0.8333333)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "idx long, cik string, filtered_text string")
    sample, stats = sampling.sample_firms(none)
    assert sample.count() == 0 and tuple(stats.first()) == (0, 0.0)


def test_file_sample_with_ids_that_restart(spark):
    rows = [(i, f"firm{i % 5}", f"text {f} {i}", f"file{f}") for f in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "idx long, cik string, filtered_text string, file string")
    sample, stats = sampling.sample_files(df, nmax=None)
    got = sample.collect()
    assert len(got) == 15 and len({(r.file, r.cik) for r in got}) == 15
    assert all(r.filtered_text == f"text {r.file[-1]} {r.idx}" for r in got)
    assert {(r.unique_firms, r.select_per) for r in stats.collect()} == {(5, 1.0)}


def test_reading_changes_no_setting(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("cik,t\n1,“x”\n".encode("cp1252"))
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert SRC.read_csv(spark, f"{tmp_path}/a.csv").first().t == "“x”"
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_all_terms_are_kept_without_a_limit(spark):
    df = spark.range(2).select(F.transform(F.sequence(F.lit(1), F.lit(25_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))).alias("grams"))
    stage = training.ModelSpec().feature_stages({"max_df": 1.0})[1]
    assert len(stage.fit(df).vocabulary) == 25_000
    assert len(training.ModelSpec().feature_stages({"max_df": 1.0, "max_features": 10})[1].fit(df).vocabulary) == 10


def test_counter_is_told_the_rows(spark):
    """A counter that has only a share keeps the terms of all rows to count the rows; the vocabulary is the same."""
    assert [max_share(0.8, 10), max_share(0.9, 1), max_share(0.9, 2, 2.0), max_share(0.8), max_share(1.0, 5)] == [8.0, 0.9, 0.9, 0.8, 2.0**62]
    texts = spark.createDataFrame([(i, f"all w{i % 4} v{i % 2}") for i in range(20)] + [(20, "")], "idx long, text string")
    for share, kept in ((0.9, {"w0", "w1", "w2", "w3", "v0", "v1"}), (0.96, {"all", "w0", "w1", "w2", "w3", "v0", "v1"}), (10 / 21, {"w0", "w1", "w2", "w3", "v0", "v1"})):
        model, _, words = topics.lda_topics(texts, F.split("text", " "), k=2, max_df=share, max_iter=1)
        assert set(words) == kept and model.stages[0].getMaxDF() == share * 21
    stages = training.ModelSpec().feature_stages({"max_df": 0.8}, 50)
    assert stages[1].getMaxDF() == 40.0


def test_margin_threshold_holds_when_scoring(spark):
    rows = [(i, float(i - 10) / 10) for i in range(21)]

    class Margin:
        def transform(self, data):
            return data.withColumn("rawPrediction", self.vector(data)).withColumn("prediction", (F.col("x") > 0).cast("double"))

        def vector(self, data):
            from pyspark.ml.functions import array_to_vector

            return array_to_vector(F.array(-F.col("x"), F.col("x")))

    data = spark.createDataFrame(rows, "id int, x double")
    scored = predict.score_sentences(data, Margin(), -0.5)
    assert {r.id for r in scored.where("pred = 1").collect()} == {i for i, x in rows if x > -0.5}


def test_natural_full_counts_nulls_as_equal(spark):
    new = spark.createDataFrame([(1, None, 5), (2, "b", 6)], "idx int, t string, a int")
    old = spark.createDataFrame([(1, None, 7), (3, "c", 8)], "idx int, t string, b int")
    assert sorted(tables.natural_full(new, old).collect()) == [(1, None, 5, 7), (2, "b", 6, None), (3, "c", None, 8)]


def test_csv_sources(spark, tmp_path):
    folder = tmp_path / "tinfo"
    folder.mkdir()
    (folder / "breach_8-K_2014.csv").write_bytes('cik,filtered_text\n1,"Café, a ""b""\nline"\n'.encode("utf-8"))
    (folder / "breach_8-K_2015.csv").write_bytes("cik,filtered_text\n2,Café “x”\n".encode("cp1252"))
    (folder / "breach_10-K_2014.csv").write_bytes(b"cik,filtered_text\n3,plain\n")
    df = SRC.read_filings(spark, str(folder), ["8-K"])
    got = sorted((r.cik, r.filtered_text, r.form_type, r.year) for r in df.collect())
    assert got == [("1", 'Café, a "b"\nline', "8-K", 2014), ("2", "Café “x”", "8-K", 2015)]
    assert SRC.read_filings(spark, str(folder), ["8-K"], year=2015).count() == 1
    keys = {r.idx for r in df.collect()}
    assert len(keys) == 2 and keys == {r.idx for r in SRC.read_filings(spark, str(folder), ["8-K"]).collect()}
    sample, _ = sampling.sample_files(df, nmax=1)
    assert sample.count() == 2
    both = SRC.merge_csv(spark, [f"{folder}/breach_8-K_2014.csv", f"{folder}/absent.csv", f"{folder}/breach_10-K_2014.csv"], str(tmp_path / "out.csv"))
    assert both.count() == 2 and SRC.read_csv(spark, str(tmp_path / "out.csv")).count() == 2
    assert SRC.read_csv(spark, f"{folder}/absent.csv") is None
    with pytest.raises(ValueError):
        SRC.merge_csv(spark, [f"{folder}/absent.csv"])


def test_many_files_with_few_headers_are_few_scans(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"a{i}.csv").write_text(f"cik,note\n{i},n{i}\n")
    for i in range(3):
        (tmp_path / f"b{i}.csv").write_text(f"note,more,cik\nm{i},x{i},{100 + i}\n")
    (tmp_path / "c.csv").write_bytes("cik,note\n200,“q”\n".encode("cp1252"))
    (tmp_path / "empty.csv").write_text("")
    merged = SRC.merge_csv(spark, [str(p) for p in sorted(tmp_path.iterdir())])
    rows = {(r.cik, r.note, r.more) for r in merged.collect()}
    assert rows == {(str(i), f"n{i}", None) for i in range(12)} | {(str(100 + i), f"m{i}", f"x{i}") for i in range(3)} | {("200", "“q”", None)}
    assert merged._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 3


def test_natural_full_on_texts(spark):
    new = spark.createDataFrame([("a" * 5000, 1, 1), (None, 2, 2), ("c", 3, 3)], "text string, k int, x int")
    old = spark.createDataFrame([("a" * 5000, 1, 7), (None, 2, 8), ("c", None, 9)], "text string, k int, y int")
    got = {tuple(r) for r in tables.natural_full(new, old).collect()}
    assert got == {("a" * 5000, 1, 1, 7), (None, 2, 2, 8), ("c", 3, 3, None), ("c", None, None, 9)}


@pytest.mark.parametrize("chunk_bytes", [1, 300, chunks.CHUNK_BYTES])
def test_own_function_over_chunks(spark, chunk_bytes):
    df = spark.range(500).select(
        F.col("id").alias("idx"), F.when(F.col("id") % 50 == 7, "bad").otherwise(F.col("id").cast("string")).alias("t"), F.lit(1).alias("more")
    )
    df = df.unionByName(spark.createDataFrame([(500, None, 1), (501, "9" * 400, 1), (7, "12", 1)], "idx long, t string, more int"))

    def function(rows):
        if len(rows) > 1 and rows["t"].map(lambda t: len(t or "")).sum() > chunk_bytes:
            raise AssertionError("more than the bytes of a chunk")
        return pd.DataFrame({"n": [int(t) for t in rows["t"]]})

    done, failed = chunks.map_chunks(df, function, "n long", chunk_bytes=chunk_bytes)
    good = {(i, i) for i in range(500) if i % 50 != 7} | {(7, 12)}
    assert sorted(map(tuple, done.collect())) == sorted(good)
    assert sorted(r.idx for r in failed.collect()) == [*range(7, 500, 50), 500, 501]
    kinds = {r.idx: r.error.split(":")[0] for r in failed.collect()}
    assert kinds[7] == "ValueError" and kinds[500] == "TypeError"
    assert done.columns == ["idx", "n"] and done.schema["idx"].dataType == df.schema["idx"].dataType
    both = chunks.map_chunks(df.limit(0), function, "n long")
    assert [t.count() for t in both] == [0, 0]
    short = chunks.map_chunks(df.limit(3), lambda rows: rows.head(0).assign(n=1)[["n"]], "n long")
    assert [t.count() for t in short] == [0, 3]
    with pytest.raises(ValueError):
        chunks.map_chunks(df, function, "idx long")


def test_rules_from_json_lines(spark, tmp_path):
    path = tmp_path / "rules.jsonl"
    path.write_text(
        '{"label": "GOV", "pattern": "Water Board"}\n'
        '{"label": "LAW", "pattern": [{"LOWER": "the"}, {"IS_TITLE": true, "OP": "?"}, {"TEXT": {"REGEX": "^(Acts?)$"}}]}\n'
    )
    rules = read_rules(spark, str(path))
    from tellsift.functions.tokens import annotate

    df = spark.createDataFrame([("The Water Board read the Fish Acts and the Act",)], "t string")
    ents = [(t.ent, t.text) for t in df.select(annotate(F.col("t"), rules)).first()[0] if t.ent]
    assert ents == [("GOV", "Water Board"), ("LAW", "the Fish Acts"), ("LAW", "the Act")]
    assert rule_table(spark).count() == len(default_rules())


def test_scalers_leave_constant_columns(spark):
    from pyspark.ml.linalg import Vectors

    data = [[0.0, 1.0, 5.0], [0.0, 2.0, 5.0], [0.0, 4.0, 5.0], [8.0, 9.0, 5.0]]
    df = spark.createDataFrame([(Vectors.dense(r),) for r in data], ["assembled"])
    out = np.array([r.scaled.toArray() for r in ColumnScaler(spread="std").fit(df).transform(df).collect()])
    spread = np.array(data).std(axis=0)
    spread[spread == 0] = 1
    assert np.allclose(out, np.array(data) / spread)
    robust = np.array([r.scaled.toArray() for r in ColumnScaler(spread="iqr").fit(df).transform(df).collect()])
    assert np.allclose(robust[:, 2], 5.0) and np.isfinite(robust).all()


def test_text_weights_against_numpy(spark):
    from pyspark.ml.linalg import Vectors

    counts = np.array([[1, 0, 3], [2, 1, 0], [0, 0, 1.0]])
    df = spark.createDataFrame(
        [(Vectors.sparse(3, [(j, v) for j, v in enumerate(row) if v]),) for row in counts], ["counts"]
    )
    logged = SublinearTf().transform(df)
    out = SmoothIdf(inputCol="logtf").fit(logged).transform(logged)
    got = np.array([r.weighted.toArray() for r in out.collect()])
    idf = np.log(4 / (1 + (counts > 0).sum(axis=0))) + 1
    tf = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0)
    assert np.allclose(got, tf * idf)


def test_svd_against_numpy(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(0).random((30, 8))
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["id", "scaled"])
    model = TruncatedSvd(k=3).fit(df)
    basis = np.linalg.svd(x, full_matrices=False)[2][:3]
    assert np.allclose(np.abs(model.components @ basis.T), np.eye(3), atol=1e-6)
    model.write().overwrite().save(str(tmp_path / "svd"))
    again = type(model).load(str(tmp_path / "svd"))
    got = np.array([r.features.toArray() for r in again.transform(df).orderBy("id").collect()])
    assert np.allclose(got, x @ model.components.T)


def test_feature_stages(spark):
    df = spark.createDataFrame([("We may report a good result today.",)], "sents string")
    for stage in (LengthFeatures(inputCol="sents"), PosFeatures(inputCol="sents"), SentimentFeatures(inputCol="sents")):
        assert stage.transform(df).columns == ["sents", *stage.get_feature_names()]


@pytest.mark.parametrize("loss", ["frobenius", "kullback-leibler"])
def test_nmf_loss_never_rises(spark, loss):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["fish sea boat", "bank loan rate"][i % 2].split()) for _ in range(12))) for i in range(40)]
    df = spark.createDataFrame(texts, "idx long, tokens string")
    model, words = topics.nmf_topics(df, "idx", token_grams(F.col("tokens")), k=2, loss=loss, max_df=1.0, alpha=0.0, max_iter=12, tol=0.0)
    assert all(b <= a + 1e-9 for a, b in zip(model.losses, model.losses[1:]))
    assert (model.components >= 0).all() and model.rows.count() == 40
    top = topics.topic_words(spark, model.components, words, 3).collect()
    groups = {t: {r.word for r in top if r.topic == t} for t in (0, 1)}
    assert {frozenset(g) for g in groups.values()} == {frozenset({"fish", "sea", "boat"}), frozenset({"bank", "loan", "rate"})}


def sentences(spark, n=90, unknown=False):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        words = "hackers stole customer records from our network" if bad else "the board approved a dividend for this quarter"
        extra = rng.choice(["today", "again", "yesterday", "recently"])
        rows.append((i, 0, f"{words} {extra} {rng.choice('abcdefgh') * 3}.", -1 if unknown else int(bad)))
    df = spark.createDataFrame(rows, "idx long, pos int, sents string, Incident int")
    from tellsift.operators.sentences import add_tokens_pos

    return add_tokens_pos(df, lang=None).withColumn("row_id", F.col("idx"))


PARAMS = {"n_components": 5, "C": 1.0, "max_df": 1.0, "min_df": 1}


def test_training_run(spark, tmp_path):
    spec = training.ModelSpec("Baseline")
    grid = {"lowercase": [True], "sublinear_tf": [True], "min_df": [1], "max_df": [1.0]}
    runs = list(training.train_models(sentences(spark), "Incident", specs=[spec], feature_grid=grid, classifier_grid={"C": [1], "n_components": [3, 5]}))
    name, model, summary, table, errors = runs[0]
    assert name == "Baseline" and table.count() == 2
    # A score equal to the threshold counts as negative, so only rows next to it may be wrong.
    assert all(abs(r.proba - summary["threshold_f1"]) < 0.2 for r in errors.collect())
    assert summary["test_roc_auc"] == pytest.approx(1.0) and summary["valid_roc_auc"] > 0.99
    SRC.save_model(model, str(tmp_path / "model"))
    loaded = SRC.load_model(str(tmp_path / "model"))
    filings = spark.createDataFrame(
        [(1, "The board approved a dividend for this quarter. Sales of our products grew."),
         (2, "Sales grew a lot this year. Hackers stole customer records from our network yesterday. It was bad news for all.")],
        "idx long, filtered_text string",
    )
    out = predict.predict_filings(filings, loaded, summary["threshold_f1"] * 0.9, "Incident")
    assert [r.idx for r in out.collect()] == [2]
    assert out.columns == ["idx", "filtered_text", "Incident_sents", "Incident_sents_num", "Incident_proba"]
    again = predict.predict_filings(out, loaded, 0.0, "Immaterial", text_col="Incident_sents")
    assert again.first().Immaterial_sents == out.first().Incident_sents


def test_classifier_sees_written_rows(spark, monkeypatch):
    """Each of a classifier's jobs would send the feature stages' vectors, as long as the vocabulary, with its plan."""
    plans = []

    class Watched:
        def __init__(self, stage):
            self.stage = stage

        def fit(self, rows):
            plans.append(rows._jdf.queryExecution().analyzed().toString())
            return self.stage.fit(rows)

    plain = training.ModelSpec.classifier_stage
    monkeypatch.setattr(training.ModelSpec, "classifier_stage", lambda *a, **k: Watched(plain(*a, **k)))
    rows = training.with_label(sentences(spark), "Incident")
    model = training.fit_model(training.ModelSpec(), rows, PARAMS)
    assert len(plans) == 1 and "UDF" not in plans[0] and "Generate" not in plans[0]
    assert all((r.probability[1] > 0.5) == (r.label == 1) for r in model.transform(rows).collect())


def test_self_training_keeps_given_labels(spark):
    known, unknown = sentences(spark), sentences(spark, 30, unknown=True).withColumn("row_id", F.col("idx") + 1000)
    _, result = selftrain.self_train(known, unknown, "Incident", training.ModelSpec(), PARAMS, threshold=0.6, max_rounds=3)
    rows = result.collect()
    assert len(rows) == 120 and all(r.pseudo_label == r.Incident for r in rows if r.Incident != -1)
    adopted = [r for r in rows if r.Incident == -1 and r.pseudo_label != -1]
    assert adopted and all(r.pseudo_label == int(r.idx % 3 == 0) and r["round"] >= 1 for r in adopted)
    parts = [selftrain.labelled_rows(result, "Incident"), selftrain.unlabelled_rows(result)]
    assert sum(p.count() for p in parts) == 120 and selftrain.changed_rows(result, "Incident").count() == len(adopted)


def test_array_roll_up_equals_grouped(spark):
    from tellsift.functions import text as T
    from tellsift.operators import sentences as S

    df = spark.createDataFrame([(1, "A breach here. Fine now. Another breach."), (2, "All fine.")], "idx long, filtered_text string")

    def score(c):
        return scoring.keyword_score(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0)))

    cut = S.cut_filings(df, "filtered_text").withColumn("proba", score(F.col("sents")))
    grouped = scoring.filing_result(df, cut, "Incident", 0.2)
    arrays = scoring.roll_up_arrays(df, T.segment(T.normalise(F.col("filtered_text"))), score, "Incident", 0.2)
    assert sorted(arrays.collect()) == sorted(grouped.collect()) and grouped.count() == 1


def test_labelling_plan(spark):
    text = "The board approved a dividend for this quarter. Hackers stole customer records from our network. "
    rows = [(i, str(i % 4), "f.csv", text + f"Sales of unit {i} grew very fast.") for i in range(20)]
    df = spark.createDataFrame(rows, "idx long, cik string, file string, filtered_text string")
    out, stats = labelling.sentences_to_label(df, "CR", nmax=3, nsents=2)
    assert out.count() == 6 and stats.first().unique_firms == 4 and out.first().Cost == ""


def test_compare_features(spark):
    table = explore.compare_entities(sentences(spark), ["Incident"], ["DATE"])
    assert table.where("feature = 'DATE'").count() == 2
    assert explore.compare_sentiment(sentences(spark), ["Incident"]).count() == 4


def test_stream_scores_each_file_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "idx long, filtered_text string"

    def run():
        query = score_new_files(spark, folder, schema, lambda b: b.select("idx", F.length("filtered_text").alias("n")), out, state)
        query.awaitTermination()
        return spark.read.parquet(out).count()

    spark.createDataFrame([(1, "a"), (2, "bb")], schema).coalesce(1).write.parquet(folder)
    assert run() == 2
    spark.createDataFrame([(3, "ccc")], schema).coalesce(1).write.mode("append").parquet(folder)
    assert run() == 3 and run() == 3
    done = spark.createDataFrame([("a.csv",)], "file string")
    assert pending(spark.createDataFrame([("a.csv",), ("b.csv",)], "file string"), done).count() == 1


@pytest.mark.parametrize("name", ["h1_logistic", "h2_linear_svc", "h3_forest", "h3_boosted_trees", "f8_univariate_selection", "j7_score_filings", "j11_score_sentences"])
def test_model_queries_take_all_terms(spark, monkeypatch, name):
    given = caught(monkeypatch, name, spark, training, "fit_model")
    assert "max_features" not in given.args[2] and given.args[2]["n_components"] >= 50


class Caught(Exception):
    pass


def caught(monkeypatch, name, spark, module, function):
    """The arguments with which a registered query calls ``function``; nothing is read or fitted."""
    called = MagicMock(side_effect=Caught)
    monkeypatch.setattr(module, function, called)
    for helper in ("filings", "labels", "load", "training_rows"):
        monkeypatch.setattr(model_q, helper, MagicMock())
    monkeypatch.setattr(model_q.S, "to_sentences", MagicMock())
    with pytest.raises(Caught):
        all_queries()[name](spark, "nowhere")
    return called.call_args


def test_grid_query_searches_the_whole_grid(spark, monkeypatch):
    given = caught(monkeypatch, "h4_grid", spark, training, "tune")
    assert len(given.args) == 2 and not given.kwargs


def test_selftrain_query_takes_all_terms_and_rounds(spark, monkeypatch):
    given = caught(monkeypatch, "j2_selftrain", spark, selftrain, "self_train")
    assert "max_features" not in given.args[4] and given.kwargs == {"threshold": 0.9}


@pytest.mark.parametrize("name, function", [("g2_nmf", "nmf_topics"), ("g3_nmf_kl", "nmf_topics"), ("g4_lda", "lda_topics"), ("g5_topic_words", "lda_topics")])
def test_topic_queries_take_all_iterations(spark, monkeypatch, name, function):
    assert "max_iter" not in caught(monkeypatch, name, spark, topics, function).kwargs


def test_numbered_deals_a_hot_group_to_many_tasks(spark, capsys):
    rows = [("a" if i % 20 else None, (i * 7919) % 4000 if i % 50 else None, i) for i in range(4000)]
    found = ranks.numbered(spark.createDataFrame(rows, "g string, k long, row long").repartition(8), ["g"], ["k", "row"], "k")
    assert found.columns == ["g", "k", "row"]
    wanted = {}
    for g in ("a", None):
        inside = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        wanted |= {r[2]: (g, n) for n, r in enumerate(inside, 1)}
    assert {r.row: (r.g, r.k) for r in found.collect()} == wanted
    found.explain()
    numbering = [line for line in capsys.readouterr().out.splitlines() if "row_number()" in line]
    assert numbering and all("_stretch" in line for line in numbering)


@pytest.mark.parametrize("loss", ["frobenius", "kullback-leibler"])
def test_nmf_works_on_blocks_of_rows(spark, monkeypatch, loss):
    from tellsift.operators import nmf

    kept = []
    monkeypatch.setattr(nmf, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    rng = np.random.default_rng(4)
    x = rng.random((300, 8)) * (rng.random((300, 8)) < 0.5)
    rows = [(f"k{i}", [int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r > 0]]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "name string, ids array<int>, vals array<double>").coalesce(2)
    model = nmf.fit_nmf(df, "name", 8, k=3, loss=loss, max_iter=1, checkpoint_every=1)
    assert kept[0].count() == 2
    first = nmf.fit_nmf(df, "name", 8, k=3, loss=loss, max_iter=0)
    start, w = ({r["name"]: np.array(r["w"]) for r in m.rows.collect()} for m in (first, model))
    assert set(start) == set(w) == {r[0] for r in rows}
    h, l1, l2 = first.components, 0.05, 0.05
    for i in (0, 7, 299):
        old, at, v = start[f"k{i}"], x[i] > 0, x[i][x[i] > 0]
        if loss == "frobenius":
            top, low = h[:, at] @ v, h @ h.T @ old
        else:
            top, low = h[:, at] @ (v / (old @ h[:, at])), h.sum(axis=1)
        assert np.allclose(w[f"k{i}"], old * top / (low + l1 + l2 * old))
    new = np.array([w[f"k{i}"] for i in range(300)])
    given = x if loss == "frobenius" else np.where(x > 0, x / (new @ h), 0)
    low = new.T @ new @ h if loss == "frobenius" else new.sum(axis=0)[:, None]
    assert np.allclose(model.components, h * (new.T @ given) / (low + l1 + l2 * h))


def test_quartile_ranges_read_the_text_once(spark, monkeypatch):
    """Every round of the quantiles worked the vectors out anew from the text."""
    from tellsift.operators import stages

    df = spark.createDataFrame([(f"{'ab ' * i}c" if i % 5 else None,) for i in range(40)], "sents string")
    vectors = VectorAssembler(inputCols=["char_count", "unique_vs_words"], outputCol="v").transform(LengthFeatures(inputCol="sents").transform(df.dropna()))
    seen, plain = [], stages.exact_quantiles
    monkeypatch.setattr(stages, "exact_quantiles", lambda rows, *a, **k: seen.append(rows._jdf.queryExecution().analyzed().toString()) or plain(rows, *a, **k))
    found = stages.quartile_ranges(vectors, "v")
    right = np.array([r.v.toArray() for r in vectors.collect()])
    assert np.allclose(found, np.quantile(right, 0.75, axis=0) - np.quantile(right, 0.25, axis=0))
    assert seen and not any("sents" in plan for plan in seen)
