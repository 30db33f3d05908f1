"""Vectors, topics, classifiers, evaluation, self-training and scoring."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tellsift.catalog.registry import filings, labels, load, notices, query, r6
from tellsift.catalog.sqltext import (
    FILINGS, LABELS, annotated, cut, distinct_cut, inlist, lang, norm, q, replaced, score, seg, tagged, valid, with_, words_of,
)
from tellsift.catalog.text_q import COUNTED, POSF, SCORE_WORDS, TX_words, keyword, sentiment_sql
from tellsift.functions import features as X, text as TX, words as W
from tellsift.operators import evaluate as EV, frequency as FR, results, scoring, selection, sentences as S, stages, svd, topics, vectorize as V
from tellsift.plans import explore, predict, selftrain, training
from tellsift.session import written

THRESHOLD = 0.3

# ---- flagship and scoring with a rule ----

SCORED = (
    FILINGS, LABELS, cut("filings"),
    f"scored AS MATERIALIZED (SELECT idx, pos, sents, {score('sents', SCORE_WORDS)} AS proba FROM seg)",
)
ROLLED = """rolled AS (SELECT idx, string_agg(sents, chr(10) ORDER BY pos) AS Incident_sents, count(*) AS Incident_sents_num,
avg(proba) AS Incident_proba FROM scored WHERE proba > 0.3 GROUP BY idx)"""
ROLLED_OUT = "idx, cik, form_type, Incident_sents, Incident_sents_num, round(Incident_proba, 6) AS Incident_proba"
ROLLED_COLUMNS = ["idx", "cik", "form_type", "Incident_sents", "Incident_sents_num"]


def scored_sentences(spark, sf):
    cut_rows = S.cut_filings(filings(spark, sf), "filtered_text").select("idx", "pos", "sents")
    return S.computed(cut_rows, proba=keyword())


@query("flagship", with_(*SCORED, ROLLED) + f"SELECT {ROLLED_OUT} FROM filings JOIN rolled USING (idx)")
def flagship(spark, sf):
    """Filings with the sentences whose score is above the threshold, without any shuffle of text."""
    found = scoring.roll_up_arrays(
        filings(spark, sf),
        TX.segment(TX.normalise(F.col("filtered_text"))),
        lambda s: scoring.keyword_score(TX_words(s), SCORE_WORDS),
        "Incident",
        THRESHOLD,
    )
    return found.select(*ROLLED_COLUMNS, r6(F.col("Incident_proba"), "Incident_proba"))


@query("j8_rollup", with_(*SCORED, ROLLED) + "SELECT idx, Incident_sents, Incident_sents_num, round(Incident_proba, 6) AS Incident_proba FROM rolled")
def j8(spark, sf):
    positive = scored_sentences(spark, sf).where(F.col("proba") > THRESHOLD)
    return scoring.roll_up(positive, "Incident").withColumn("Incident_proba", F.round("Incident_proba", 6))


@query("c1_rollup_join", with_(*SCORED, ROLLED) + f"SELECT {ROLLED_OUT} FROM filings JOIN rolled USING (idx)")
def c1(spark, sf):
    whole = scoring.filing_result(filings(spark, sf), scored_sentences(spark, sf), "Incident", THRESHOLD)
    return whole.select(*ROLLED_COLUMNS, r6(F.col("Incident_proba"), "Incident_proba"))


@query("j9_positive_sentences", with_(*SCORED) + "SELECT idx, pos, sents, round(proba, 6) AS proba, 1 AS pred FROM scored WHERE proba > 0.3")
def j9_pos(spark, sf):
    out = scoring.filing_result(filings(spark, sf), scored_sentences(spark, sf), "Incident", THRESHOLD, "pos_sents")
    return out.withColumn("proba", F.round("proba", 6))


@query("j9_all_sentences", with_(*SCORED) + "SELECT idx, pos, sents, round(proba, 6) AS proba, CAST(proba > 0.3 AS INTEGER) AS pred FROM scored")
def j9_all(spark, sf):
    out = scoring.filing_result(filings(spark, sf), scored_sentences(spark, sf), "Incident", THRESHOLD, "all_sents")
    return out.withColumn("proba", F.round("proba", 6))


SECOND = ["is", "was", "are", "be", "by", "at", "on", "in"]


@query(
    "j10_second_pass",
    with_(
        *SCORED, ROLLED,
        "l2 AS (SELECT idx, string_split(Incident_sents, chr(10)) AS l FROM rolled)",
        "s2 AS (SELECT idx, unnest(l) AS sents, generate_subscripts(l, 1) AS pos FROM l2)",
        f"p2 AS (SELECT *, {score('sents', SECOND)} AS proba FROM s2)",
    )
    + """SELECT idx, Incident_sents, string_agg(sents, chr(10) ORDER BY pos) AS Immaterial_sents, count(*) AS Immaterial_sents_num,
round(avg(proba), 6) AS Immaterial_proba FROM p2 JOIN rolled USING (idx) WHERE proba > 0.05 GROUP BY idx, Incident_sents""",
)
def j10(spark, sf):
    first = scoring.roll_up_arrays(
        filings(spark, sf),
        TX.segment(TX.normalise(F.col("filtered_text"))),
        lambda s: scoring.keyword_score(TX_words(s), SCORE_WORDS),
        "Incident",
        THRESHOLD,
    ).select("idx", "Incident_sents")
    lines = S.cut_filings(first, "Incident_sents", lines=True)
    scored = S.computed(lines, proba=scoring.keyword_score(TX_words(F.col("sents")), SECOND))
    out = scoring.filing_result(first, scored, "Immaterial", 0.05)
    return out.withColumn("Immaterial_proba", F.round("Immaterial_proba", 6))


# ---- vectors ----

GRAMS = f"""gw AS (SELECT idx, regexp_extract_all(lower(filtered_text), {q('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}')}) AS l FROM filings),
gs AS (SELECT idx, list_filter(l, lambda w: w NOT IN {inlist(W.CR_STOP_LOWER)}) AS l FROM gw),
g AS (SELECT idx, unnest(l) AS term FROM gs UNION ALL
 SELECT idx, array_to_string(l[k:k + 1], ' ') FROM (SELECT idx, l, unnest(range(1, len(l))) AS k FROM gs)),
tf AS MATERIALIZED (SELECT idx, term, count(*) AS tf FROM g GROUP BY idx, term),
nd AS (SELECT count(*) AS n FROM filings),
voc AS MATERIALIZED (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term
 HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT n FROM nd))"""


def grams():
    return FR.gram_array(F.col("filtered_text"), 1, 2, stop=W.CR_STOP_LOWER)


def counts(spark, sf):
    return V.term_counts(filings(spark, sf), "idx", grams())


def n_filings(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").agg(F.count("*")).scalar()


def vocabulary(spark, sf):
    return V.vocabulary(counts(spark, sf), n_filings(spark, sf), 2, 0.8)


@query("f1_counts", with_(FILINGS, GRAMS) + "SELECT idx, term, tf FROM tf")
def f1(spark, sf):
    return counts(spark, sf)


@query("f1_vocabulary", with_(FILINGS, GRAMS) + "SELECT term, df, total FROM voc")
def f1_voc(spark, sf):
    return vocabulary(spark, sf)


@query("f1_vocabulary_limited", with_(FILINGS, GRAMS) + "SELECT term, df, total FROM voc ORDER BY total DESC, term LIMIT 1000")
def f1_limited(spark, sf):
    return V.vocabulary(counts(spark, sf), n_filings(spark, sf), 2, 0.8, 1000)


IDS = "ids AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY term) - 1 AS id FROM voc)"


@query("f1_sparse_rows", with_(FILINGS, GRAMS, IDS) + "SELECT idx, id, tf FROM tf JOIN ids USING (term)")
def f1_sparse_rows(spark, sf):
    """The counts with a dense number for each term, the dictionary a table."""
    held = written(counts(spark, sf))
    return V.sparse_rows(held, V.term_ids(V.vocabulary(held, n_filings(spark, sf), 2, 0.8)), "idx")


def subspace_sql(rounds: int) -> str:
    """Rounds of a block of two columns, each made orthonormal by subtraction, and the two-by-two eigenvectors at the end."""
    start = [f"CAST('0x' || substr(md5(concat_ws('|', id, {j}, 2021)), 1, 8) AS BIGINT) / 2147483648.0 - 1 AS v{j}" for j in (0, 1)]
    steps = [
        "a AS MATERIALIZED (SELECT idx, id, 1 + ln(tf) AS x FROM tf JOIN ids USING (term))",
        f"b0 AS MATERIALIZED (SELECT id, {', '.join(start)} FROM ids)",
    ]
    for r in range(rounds + 1):
        steps += [
            f"y{r} AS MATERIALIZED (SELECT idx, sum(x * v0) AS y0, sum(x * v1) AS y1 FROM a JOIN b{r} USING (id) GROUP BY idx)",
            f"z{r} AS MATERIALIZED (SELECT id, sum(x * y0) AS w0, sum(x * y1) AS w1 FROM a JOIN y{r} USING (idx) GROUP BY id)",
        ]
        if r < rounds:
            steps += [
                f"n{r} AS MATERIALIZED (SELECT sqrt(sum(w0 * w0)) AS l FROM z{r})",
                f"p{r} AS MATERIALIZED (SELECT sum(w0 / l * w1) AS d FROM z{r}, n{r})",
                f"o{r} AS MATERIALIZED (SELECT id, w0 / l AS v0, w1 - d * w0 / l AS u FROM z{r}, n{r}, p{r})",
                f"m{r} AS MATERIALIZED (SELECT sqrt(sum(u * u)) AS l FROM o{r})",
                f"b{r + 1} AS MATERIALIZED (SELECT id, v0, u / l AS v1 FROM o{r}, m{r})",
            ]
    steps += [
        f"t AS (SELECT sum(v0 * w0) AS p, sum(v0 * w1) AS q, sum(v1 * w1) AS r FROM b{rounds} JOIN z{rounds} USING (id))",
        "e AS (SELECT atan2(2 * q, p - r) / 2 AS g FROM t)",
        f"c AS (SELECT 0 AS component, id, v0 * cos(g) + v1 * sin(g) AS x FROM b{rounds}, e UNION ALL SELECT 1, id, v1 * cos(g) - v0 * sin(g) FROM b{rounds}, e)",
        "s AS (SELECT component, arg_max(sign(x), abs(x)) AS s FROM c GROUP BY component)",
    ]
    return with_(FILINGS, GRAMS, IDS, *steps) + "SELECT component, term, CASE WHEN abs(x) < 0.0000005 THEN 0.0 ELSE round(x * s, 6) END AS weight FROM c JOIN s USING (component) JOIN ids USING (id)"


@query("f5_svd_rounds", subspace_sql(3))
def f5_rounds(spark, sf):
    """Two components of the logarithmic counts after three rounds without further columns."""
    held = written(counts(spark, sf))
    numbered = written(V.term_ids(V.vocabulary(held, n_filings(spark, sf), 2, 0.8)))
    rows = V.sparse_rows(held, numbered, "idx")
    found = svd.leading(rows.select(F.col("idx").alias("row"), F.col("id").alias("col"), (1 + F.log("tf")).alias("value")), 2, rounds=3, extra=0)
    named = found.weights().join(numbered.select(F.col("id").alias("col"), "term"), "col")
    weight = F.when(F.abs("weight") < 0.0000005, F.lit(0.0)).otherwise(F.round("weight", 6))
    return named.select("component", "term", weight.alias("weight"))


def weights_sql(tf: str) -> str:
    return with_(
        FILINGS, GRAMS,
        f"""w AS (SELECT idx, term, {tf} * (ln((1.0 + (SELECT n FROM nd)) / (1.0 + df)) + 1) AS x FROM tf JOIN voc USING (term))""",
    ) + "SELECT idx, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY idx)), 6) AS weight FROM w"


@query("f2_tfidf", weights_sql("tf"))
def f2(spark, sf):
    t = V.corpus_tfidf(filings(spark, sf), "idx", grams(), n_filings(spark, sf), 2, 0.8)
    return t.select("idx", "term", r6(F.col("weight"), "weight"))


@query("f3_sublinear", weights_sql("(1 + ln(tf))"))
def f3(spark, sf):
    t = V.corpus_tfidf(filings(spark, sf), "idx", grams(), n_filings(spark, sf), 2, 0.8, sublinear=True)
    return t.select("idx", "term", r6(F.col("weight"), "weight"))


# ---- evaluation on the rule score ----

EVAL = (
    *SCORED,
    "e AS MATERIALIZED (SELECT idx, pos, Incident, Immaterial, proba FROM scored JOIN lab USING (idx))",
    "pt AS (SELECT proba AS threshold, count(*) FILTER (Incident = 1) AS pos, count(*) FILTER (Incident <> 1) AS neg FROM e GROUP BY proba)",
    """cum AS MATERIALIZED (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, lead(pos) OVER o AS npos, lead(neg) OVER o AS nneg,
 row_number() OVER o AS r, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM pt
 WINDOW d AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING), o AS (ORDER BY threshold DESC))""",
    "pr AS (SELECT threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM cum)",
    "roc AS (SELECT threshold, tp / p AS tpr, fp / n AS fpr FROM cum WHERE r = 1 OR npos IS NULL OR NOT (npos = pos AND nneg = neg))",
)


def evaluated(spark, sf):
    """Scored sentences of labelled filings; labels meet the filings, so that the sentences of others aren't cut and scored."""
    f = filings(spark, sf).join(labels(spark, sf), "idx")
    cut_rows = S.cut_filings(f, "filtered_text").select("idx", "pos", "sents", "Incident", "Immaterial")
    return S.computed(cut_rows, proba=keyword()).select("idx", "pos", "proba", "Incident", "Immaterial")


def points(spark, sf):
    return EV.cumulative(evaluated(spark, sf), "proba", "Incident")


@query(
    "i1_pr_curve",
    with_(*EVAL) + "SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr UNION ALL SELECT NULL, 1.0, 0.0",
)
def i1(spark, sf):
    return EV.pr_curve(points(spark, sf)).select(*[r6(F.col(c), c) for c in ("threshold", "precision", "recall")])


@query(
    "i2_roc_curve",
    with_(*EVAL) + "SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM roc UNION ALL SELECT 'infinity'::DOUBLE, 0.0, 0.0",
)
def i2(spark, sf):
    return EV.roc_curve(points(spark, sf)).select(*[r6(F.col(c), c) for c in ("threshold", "tpr", "fpr")])


F1 = "coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)"


@query("i3_best_f1", with_(*EVAL) + f"SELECT round(threshold, 6) AS threshold, round({F1}, 6) AS f1 FROM pr ORDER BY {F1} DESC, pr.threshold LIMIT 1")
def i3(spark, sf):
    return EV.best_f1(points(spark, sf)).select(r6(F.col("threshold"), "threshold"), r6(F.col("f1"), "f1"))


@query(
    "i4_best_gmean",
    with_(*EVAL) + "SELECT round(threshold, 6) AS threshold, round(sqrt(tpr * (1 - fpr)), 6) AS gmean FROM roc ORDER BY sqrt(tpr * (1 - fpr)) DESC, roc.threshold DESC LIMIT 1",
)
def i4(spark, sf):
    return EV.best_gmean(points(spark, sf)).select(r6(F.col("threshold"), "threshold"), r6(F.col("gmean"), "gmean"))


@query(
    "i6_ap_auc",
    with_(*EVAL) + "SELECT round(sum(pos / p * (tp / (tp + fp))), 6) AS pr_auc, round(sum(neg / n * ((tp - pos / 2) / p)), 6) AS roc_auc FROM cum",
)
def i6(spark, sf):
    return EV.areas(points(spark, sf)).select(r6(F.col("pr_auc"), "pr_auc"), r6(F.col("roc_auc"), "roc_auc"))


CONF = "c AS (SELECT count(*) FILTER (Incident = 1 AND proba > 0.3) AS tp, count(*) FILTER (Incident <> 1 AND proba > 0.3) AS fp, count(*) FILTER (Incident = 1 AND proba <= 0.3) AS fn{by} FROM e{group})"
PRF = "round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1"


@query("i7_prf", with_(*EVAL, CONF.format(by="", group="")) + f"SELECT {PRF} FROM c")
def i7(spark, sf):
    p = EV.apply_threshold(evaluated(spark, sf), THRESHOLD)
    return EV.precision_recall_f1(p, "Incident").select(*[r6(F.col(c), c) for c in ("precision", "recall", "f1")])


@query(
    "h8_compare_models",
    with_(*EVAL, CONF.format(by=", cik AS model_name", group=" JOIN (SELECT idx, cik FROM filings) USING (idx) GROUP BY cik"))
    + f"SELECT model_name, {PRF.replace('round(tp / (tp + fp), 6)', 'round(coalesce(tp / nullif(tp + fp, 0), 0), 6)').replace('round(tp / (tp + fn), 6)', 'round(coalesce(tp / nullif(tp + fn, 0), 0), 6)').replace('round(2 * tp / (2 * tp + fp + fn), 6)', 'round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6)')} FROM c",
)
def h8(spark, sf):
    """One row of scores per source, each source standing for a model; the table is built from the models' summaries."""
    p = EV.apply_threshold(evaluated(spark, sf), THRESHOLD).join(filings(spark, sf).select("idx", F.col("cik").alias("model_name")), "idx")
    found = EV.precision_recall_f1(p, "Incident", by=["model_name"]).select(
        "model_name", *[r6(F.col(c), c) for c in ("precision", "recall", "f1")]
    )
    return results.model_table(spark, [row.asDict() for row in found.collect()])


@query("i8_apply_threshold", with_(*EVAL) + "SELECT idx, pos, CAST(proba > 0.3 AS INTEGER) AS pred, CAST(proba >= 0.25 AS INTEGER) AS pred_incl FROM e")
def i8(spark, sf):
    p = EV.apply_threshold(evaluated(spark, sf), THRESHOLD)
    return EV.apply_threshold(p, 0.25, out="pred_incl", inclusive=True).select("idx", "pos", "pred", "pred_incl")


@query(
    "i10_errors",
    with_(*EVAL) + "SELECT idx, pos, Incident, CAST(proba > 0.3 AS INTEGER) AS pred, round(proba, 6) AS proba FROM e WHERE CAST(proba > 0.3 AS INTEGER) <> Incident",
)
def i10(spark, sf):
    p = EV.apply_threshold(evaluated(spark, sf), THRESHOLD)
    return EV.prediction_errors(p, "Incident").select("idx", "pos", "Incident", "pred", r6(F.col("proba"), "proba"))


@query("i11_no_skill", with_(*EVAL) + "SELECT round(avg(CASE WHEN Incident = 1 THEN 1.0 ELSE 0.0 END), 6) AS no_skill FROM e")
def i11(spark, sf):
    return EV.no_skill(evaluated(spark, sf), "Incident").select(r6(F.col("no_skill"), "no_skill"))


@query(
    "i12_distribution",
    with_(
        FILINGS, LABELS, cut("filings"),
        "w AS (SELECT idx, string_split(sents, ' ') AS l FROM seg)",
        "m AS (SELECT idx, CAST(length(array_to_string(l, '')) AS DOUBLE) AS c, len(l) AS n, len(list_distinct(l)) AS u FROM w)",
        "f AS (SELECT idx, ln(c + 1) AS char_count, c / n AS avg_word_length, ln(u + 1) AS unique_count, u / n AS unique_vs_words FROM m JOIN lab USING (idx))",
        "x AS (UNPIVOT f ON char_count, avg_word_length, unique_count, unique_vs_words INTO NAME feature VALUE v)",
        "k AS (SELECT feature, 'Incident' AS key, CAST(Incident AS VARCHAR) AS value, v FROM x JOIN lab USING (idx) UNION ALL SELECT feature, 'Immaterial', CAST(Immaterial AS VARCHAR), v FROM x JOIN lab USING (idx))",
    )
    + """SELECT feature, key, value, count(*) AS rows, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev, round(min(v), 6) AS low,
round(quantile_disc(v, 0.25), 6) AS q25, round(quantile_disc(v, 0.5), 6) AS median, round(quantile_disc(v, 0.75), 6) AS q75, round(max(v), 6) AS high FROM k GROUP BY ALL""",
)
def i12(spark, sf):
    f = filings(spark, sf).join(labels(spark, sf), "idx")
    s = S.cut_filings(f, "filtered_text").select("sents", "Incident", "Immaterial")
    table = explore.compare_lengths(s, ["Incident", "Immaterial"])
    return table.select(
        "feature", "key", "value", "rows", *[r6(F.col(c), c) for c in ("mean", "stddev", "low", "q25", "median", "q75", "high")]
    )


def compared(features: str, *parts: str) -> str:
    """SQL of a comparison by label: ``f`` holds one row per sentence with ``idx`` and the features."""
    return with_(
        FILINGS, LABELS, *parts,
        f"x AS (UNPIVOT f ON {features} INTO NAME feature VALUE v)",
        "k AS (SELECT feature, 'Incident' AS key, CAST(Incident AS VARCHAR) AS value, v FROM x JOIN lab USING (idx) "
        "UNION ALL SELECT feature, 'Immaterial', CAST(Immaterial AS VARCHAR), v FROM x JOIN lab USING (idx))",
        recursive=True,
    ) + """SELECT feature, key, value, count(*) AS rows, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS stddev, round(min(v), 6) AS low,
round(quantile_disc(v, 0.25), 6) AS q25, round(quantile_disc(v, 0.5), 6) AS median, round(quantile_disc(v, 0.75), 6) AS q75, round(max(v), 6) AS high FROM k GROUP BY ALL"""


def compared_rows(table):
    return table.select(
        "feature", "key", "value", "rows", *[F.round(F.col(c), 4).alias(c) for c in ("mean", "stddev")],
        *[r6(F.col(c), c) for c in ("low", "q25", "median", "q75", "high")],
    )


def labelled_cut(spark, sf):
    f = filings(spark, sf).join(labels(spark, sf), "idx")
    return S.cut_filings(f, "filtered_text").select("sents", "Incident", "Immaterial")


@query("i12_pos", compared(POSF, cut("filings"), annotated(), tagged(), f"f AS (SELECT idx, {POSF} FROM posf)"))
def i12_pos(spark, sf):
    return compared_rows(explore.compare_pos(labelled_cut(spark, sf), ["Incident", "Immaterial"]))


@query(
    "i12_sentiment",
    compared("polarity, subjectivity", f"f AS ({sentiment_sql('filings', FILINGS)})"),
)
def i12_sentiment(spark, sf):
    return compared_rows(explore.compare_sentiment(labelled_cut(spark, sf), ["Incident", "Immaterial"]))


@query(
    "i12_entities",
    compared(
        ", ".join(f'"{c}"' for c in COUNTED), cut("filings"), annotated(), replaced(W.CR_LABELS),
        "f AS (SELECT idx, " + ", ".join(f"CAST(count(*) FILTER (tok = '{c}') AS DOUBLE) AS \"{c}\"" for c in COUNTED)
        + " FROM seg LEFT JOIN toks USING (idx, pos) GROUP BY idx, pos)",
    ),
)
def i12_entities(spark, sf):
    return compared_rows(explore.compare_entities(labelled_cut(spark, sf), ["Incident", "Immaterial"], W.CR_LABELS))


RESULTS = """res AS (SELECT form_type AS model_name, Incident AS C, 'l2' AS penalty, Immaterial AS k, avg(proba) AS mean_train_roc_auc, max(proba) AS mean_test_roc_auc
 FROM e JOIN (SELECT idx, form_type FROM filings) USING (idx) GROUP BY ALL)"""


@query(
    "h7_unpivot",
    with_(*EVAL, RESULTS)
    + """SELECT model_name, param, value, part, 'roc_auc' AS measure, round(score, 6) AS score FROM (
SELECT model_name, 'C' AS param, CAST(C AS VARCHAR) AS value, 'train' AS part, mean_train_roc_auc AS score FROM res
UNION ALL SELECT model_name, 'C', CAST(C AS VARCHAR), 'validation', mean_test_roc_auc FROM res
UNION ALL SELECT model_name, 'k', CAST(k AS VARCHAR), 'train', mean_train_roc_auc FROM res
UNION ALL SELECT model_name, 'k', CAST(k AS VARCHAR), 'validation', mean_test_roc_auc FROM res)""",
)
def h7(spark, sf):
    """Mean scores by label values, which stand for the parameters of a search."""
    e = evaluated(spark, sf).join(filings(spark, sf).select("idx", F.col("form_type").alias("model_name")), "idx")
    table = e.groupBy("model_name", F.col("Incident").alias("C"), F.lit("l2").alias("penalty"), F.col("Immaterial").alias("k")).agg(
        F.avg("proba").alias("mean_train_roc_auc"), F.max("proba").alias("mean_test_roc_auc")
    )
    return results.search_long(table, ["C", "penalty", "k"]).withColumn("score", F.round("score", 6))


# ---- self-training tables ----

STUB = (
    *SCORED,
    """u AS (SELECT idx, pos, coalesce(Incident, -1) AS y, proba FROM scored LEFT JOIN lab USING (idx))""",
    "r AS (SELECT *, CASE WHEN y <> -1 THEN y WHEN proba > 0.4 THEN 1 WHEN proba < 0.1 THEN 0 ELSE -1 END AS pseudo FROM u)",
)


def stub(spark, sf):
    """A self-training result in which the rule score plays the model."""
    s = scored_sentences(spark, sf).select("idx", "pos", "proba").join(labels(spark, sf).select("idx", "Incident"), "idx", "left")
    train, rest = s.where("Incident is not null"), s.where("Incident is null")
    rows = selftrain.add_unlabelled(train, rest, "Incident")
    pseudo = (
        F.when(F.col("Incident") != -1, F.col("Incident"))
        .when(F.col("proba") > 0.4, 1).when(F.col("proba") < 0.1, 0).otherwise(-1)
    )
    return rows.withColumn("pseudo_label", pseudo)


@query("j1_unlabelled_set", with_(*STUB) + "SELECT idx, pos, y AS Incident FROM u")
def j1(spark, sf):
    return stub(spark, sf).select("idx", "pos", "Incident")


OUT = "idx, pos, y AS true_label, pseudo AS Incident"


@query("j4_labelled", with_(*STUB) + f"SELECT {OUT} FROM r WHERE y <> -1 OR pseudo <> -1")
def j4(spark, sf):
    return selftrain.labelled_rows(stub(spark, sf), "Incident").select("idx", "pos", "true_label", "Incident")


@query("j5_changed", with_(*STUB) + f"SELECT {OUT} FROM r WHERE y <> pseudo")
def j5(spark, sf):
    return selftrain.changed_rows(stub(spark, sf), "Incident").select("idx", "pos", "true_label", "Incident")


@query("j6_unlabelled", with_(*STUB) + "SELECT idx, pos, y AS Incident, pseudo AS pseudo_label FROM r WHERE pseudo = -1")
def j6(spark, sf):
    return selftrain.unlabelled_rows(stub(spark, sf)).select("idx", "pos", "Incident", "pseudo_label")


# ---- feature stages and scalers ----

LENGTHS = (
    "w AS (SELECT idx, pos, string_split(sents, ' ') AS l FROM seg)",
    "m AS (SELECT idx, pos, CAST(length(array_to_string(l, '')) AS DOUBLE) AS c, len(l) AS n, len(list_distinct(l)) AS u FROM w)",
    "f AS (SELECT idx, pos, ln(c + 1) AS char_count, c / n AS avg_word_length, ln(u + 1) AS unique_count, u / n AS unique_vs_words FROM m)",
)


def cut_rows(spark, sf):
    return S.cut_filings(filings(spark, sf), "filtered_text").select("idx", "pos", "sents")


@query(
    "e23_length_stage",
    with_(FILINGS, cut("filings"), *LENGTHS) + "SELECT idx, pos, " + ", ".join(f"round({c}, 6) AS {c}" for c in X.LENGTH_COLUMNS) + " FROM f",
)
def e23_length(spark, sf):
    out = stages.LengthFeatures(inputCol="sents").transform(cut_rows(spark, sf))
    return out.select("idx", "pos", *[r6(F.col(c), c) for c in X.LENGTH_COLUMNS])


@query("e23_sentiment_stage", sentiment_sql("filings", FILINGS))
def e23_sentiment(spark, sf):
    out = stages.SentimentFeatures(inputCol="sents").transform(cut_rows(spark, sf))
    return out.select("idx", "pos", *[r6(F.col(c), c) for c in X.SENTIMENT_COLUMNS])


def scaler_query(name, scaler, spread):
    scaled = ", ".join(f"round({c} / {spread.format(c)}, 4) AS {c}" for c in X.LENGTH_COLUMNS)

    @query(name, with_(FILINGS, cut("filings"), *LENGTHS) + f"SELECT idx, pos, {scaled} FROM f")
    def run(spark, sf):
        lengths = stages.LengthFeatures(inputCol="sents").transform(cut_rows(spark, sf))
        # the scaler reads these rows more than once, and the text is cut for them only once
        table = written(VectorAssembler(inputCols=list(X.LENGTH_COLUMNS), outputCol="lengths").transform(lengths).select("idx", "pos", "lengths"))
        out = stages.SCALERS[scaler]("lengths", "scaled").fit(table).transform(table)
        values = training.vector_to_array("scaled")
        return out.select("idx", "pos", *[F.round(values[i], 4).alias(c) for i, c in enumerate(X.LENGTH_COLUMNS)])


scaler_query("f4_maxabs", "maxabs", "max(abs({})) OVER ()")
scaler_query("f4_std", "std", "stddev_pop({}) OVER ()")
# a column without a spread is left as it is
scaler_query("f4_robust", "robust", "coalesce(nullif(quantile_cont({0}, 0.75) OVER () - quantile_cont({0}, 0.25) OVER (), 0), 1)")


# Only values above zero are given; the operator counts the others as what is missing.
@query(
    "f8_mutual_information",
    """
WITH v AS (SELECT l_returnflag AS label, unnest(['quantity', 'price', 'discount', 'tax', 'month']) AS feature,
                  unnest([CAST(l_quantity AS DOUBLE), l_extendedprice, l_discount, l_tax, month(l_shipdate)]) AS x FROM lineitem),
e AS (SELECT feature, list_distinct(quantile_disc(x, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS edges FROM v GROUP BY feature),
b AS (SELECT feature, label, len(list_filter(edges, lambda y: y < x)) AS bin FROM v JOIN e USING (feature)),
c AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS in_bin, sum(n) OVER (PARTITION BY feature, label) AS size, sum(n) OVER (PARTITION BY feature) AS total FROM c)
SELECT feature, round(sum(n / total * ln(CAST(n AS DOUBLE) * total / (CAST(in_bin AS DOUBLE) * size))), 6) AS mi FROM s GROUP BY feature
""",
)
def f8_mutual_information(spark, sf):
    rows = load(spark, f"{sf}/lineitem.parquet")
    values = rows.select(
        F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.month("l_shipdate").cast("double").alias("month"),
    )
    sizes = {r["label"]: r["count"] for r in values.groupBy("label").count().collect()}
    cells = values.unpivot("label", ["quantity", "price", "discount", "tax", "month"], "feature", "value").where("value <> 0")
    return selection.mutual_information(cells, sizes).select("feature", r6(F.col("mi"), "mi"))


# ---- models: rows only ----


def labelled_sentences(spark, sf):
    f = filings(spark, sf).join(labels(spark, sf), "idx")
    s = S.to_sentences(f, "filtered_text", W.CR_LABELS)
    return s.withColumn("row_id", F.concat_ws("-", "idx", "pos"))


def training_rows(spark, sf):
    return training.with_label(labelled_sentences(spark, sf), "Immaterial")


# One candidate of settings, over all terms.
SMALL = {"n_components": 50, "C": 1.0, "max_df": 0.8, "lowercase": True}


def whole_text_grams(low=1, high=2):
    return FR.gram_array(F.col("filtered_text"), low, high, stop=W.CR_STOP_LOWER)


@query("f5_svd")
def f5(spark, sf):
    weights, _ = topics.lsa_topics(filings(spark, sf), "idx", whole_text_grams(), k=10)
    return topics.rank_words(weights, 1000)


@query("g1_lsa")
def g1(spark, sf):
    weights, _ = topics.lsa_topics(filings(spark, sf), "idx", whole_text_grams(), k=10)
    return topics.rank_words(weights, 20)


def nmf_query(name, loss):
    @query(name)
    def run(spark, sf):
        model, words = topics.nmf_topics(filings(spark, sf), "idx", whole_text_grams(), k=10, loss=loss)
        return topics.topic_words(spark, model.components, words, 20)


nmf_query("g2_nmf", "frobenius")
nmf_query("g3_nmf_kl", "kullback-leibler")


@query("g4_lda")
def g4(spark, sf):
    model, _, _ = topics.lda_topics(filings(spark, sf), whole_text_grams(), k=10)
    mixed = model.transform(S.computed(filings(spark, sf), grams=whole_text_grams()))
    return mixed.select("idx", training.vector_to_array("topicDistribution").alias("mix")).select(
        "idx", F.posexplode("mix").alias("topic", "weight")
    )


@query("g5_topic_words")
def g5(spark, sf):
    _, components, words = topics.lda_topics(filings(spark, sf), whole_text_grams(), k=10)
    return topics.topic_words(spark, components, words, 20)


G5_SQL = with_(FILINGS, GRAMS, "tt AS (SELECT form_type AS topic, term AS word, CAST(sum(tf) AS DOUBLE) AS weight FROM tf JOIN filings USING (idx) GROUP BY ALL)") + (
    "SELECT * FROM (SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS INTEGER) AS rank, word, weight FROM tt) WHERE rank <= 20"
)


@query("g5_top_words_per_group", G5_SQL)
def g5_group(spark, sf):
    """Heaviest words per language, each language standing for a topic."""
    c = counts(spark, sf).join(filings(spark, sf).select("idx", F.col("form_type").alias("topic")), "idx")
    table = c.groupBy("topic", F.col("term").alias("word")).agg(F.sum("tf").cast("double").alias("weight"))
    return topics.rank_words(table, 20)


@query("h1_logistic")
def h1(spark, sf):
    spec = training.ModelSpec("Baseline", stop_lower=W.CR_STOP_LOWER)
    rows = training_rows(spark, sf).persist()
    model = training.fit_model(spec, rows, SMALL)
    return training.positive_score(model.transform(rows)).select("row_id", "label", "proba")


def classifier_query(name, classifier):
    @query(name)
    def run(spark, sf):
        spec = training.ModelSpec(classifier, classifier=classifier)
        rows = training_rows(spark, sf).persist()
        model = training.fit_model(spec, rows, {**SMALL, "trees": 10, "depth": 4})
        return training.positive_score(model.transform(rows), "margin").select("row_id", "label", "proba")


classifier_query("h2_linear_svc", "linear_svc")
classifier_query("h3_forest", "forest")
classifier_query("h3_boosted_trees", "gbt")


@query("f8_univariate_selection")
def f8(spark, sf):
    spec = training.ModelSpec("Selected", fselector="f", scaler="maxabs")
    rows = training_rows(spark, sf).persist()
    model = training.fit_model(spec, rows, SMALL)
    return training.positive_score(model.transform(rows)).select("row_id", "label", "proba")


@query("h4_grid")
def h4(spark, sf):
    rows = training_rows(spark, sf)
    spec = training.ModelSpec("Baseline", stop_lower=W.CR_STOP_LOWER, stop_cased=W.CR_STOP_CASED)
    _, _, table = training.tune(spec, rows)
    return table


@query("j2_selftrain")
def j2(spark, sf):
    cut_rows = S.to_sentences(filings(spark, sf), "filtered_text", W.CR_LABELS)
    s = cut_rows.withColumn("row_id", F.concat_ws("-", "idx", "pos")).join(labels(spark, sf), "idx", "left").persist()
    _, result = selftrain.self_train(
        s.where("Immaterial is not null"), s.where("Immaterial is null"), "Immaterial",
        training.ModelSpec(fselector="svd"), SMALL, threshold=0.9,
    )
    return result.select("row_id", "Immaterial", "pseudo_label", "round", "Immaterial_proba")


ROUNDS, SURE = 10, 0.95


def rounds_sql() -> str:
    """Every round counted anew over all known rows; a round after the last that adopts changes nothing."""
    parts = [
        "tm AS MATERIALIZED (SELECT idx || '-' || pos AS row_id, list_distinct(" + words_of("sents") + ") AS terms FROM seg)",
        "ct AS MATERIALIZED (SELECT row_id, unnest(terms) AS t FROM tm)",
        "v AS (SELECT greatest(count(DISTINCT t), 1) AS v FROM ct)",
        "s0 AS MATERIALIZED (SELECT row_id, coalesce(Immaterial, -1) AS y, y AS label, CASE WHEN y <> -1 THEN 0 END AS round "
        "FROM tm LEFT JOIN lab ON lab.idx = CAST(split_part(row_id, '-', 1) AS BIGINT))",
    ]
    for r in range(ROUNDS + 1):
        parts += [
            f"k{r} AS MATERIALIZED (SELECT t, count_if(label = 1) AS p, count_if(label = 0) AS n FROM ct JOIN s{r} USING (row_id) WHERE label <> -1 GROUP BY t)",
            f"z{r} AS MATERIALIZED (SELECT coalesce(sum(p), 0) + any_value(v) AS p, coalesce(sum(n), 0) + any_value(v) AS n FROM v LEFT JOIN k{r} ON true)",
            f"m{r} AS (SELECT row_id, sum(ln((coalesce(k.p, 0) + 1) / z.p) - ln((coalesce(k.n, 0) + 1) / z.n)) AS w FROM ct LEFT JOIN k{r} k USING (t), z{r} z GROUP BY row_id)",
            f"q{r} AS MATERIALIZED (SELECT s.*, 1 / (1 + exp(-(ln((SELECT (count_if(label = 1) + 1) / (count_if(label = 0) + 1) FROM s{r})) + coalesce(w, 0)))) AS pr FROM s{r} s LEFT JOIN m{r} USING (row_id))",
        ]
        if r < ROUNDS:
            sure = f"label = -1 AND greatest(pr, 1 - pr) > {SURE}"
            parts.append(
                f"s{r + 1} AS MATERIALIZED (SELECT row_id, y, CASE WHEN {sure} THEN CAST(pr > 0.5 AS INTEGER) ELSE label END AS label, "
                f"CASE WHEN {sure} THEN {r + 1} ELSE round END AS round FROM q{r})"
            )
    return with_(FILINGS, cut("filings"), LABELS, *parts) + (
        f"SELECT row_id, y AS Immaterial, label AS pseudo_label, CAST(round AS INTEGER) AS round, round(pr, 6) AS proba FROM q{ROUNDS}"
    )


@query("j2_rounds", rounds_sql())
def j2_rounds(spark, sf):
    """Self-training over all sentences by counts of their words, all ten rounds."""
    cut_rows = S.cut_filings(filings(spark, sf), "filtered_text").join(labels(spark, sf), "idx", "left")
    rows = cut_rows.select(F.concat_ws("-", "idx", "pos").alias("row_id"), TX_words(F.col("sents")).alias("terms"), "Immaterial")
    out = selftrain.self_train_by_counts(rows, "Immaterial", threshold=SURE, max_rounds=ROUNDS)
    return out.select("row_id", "Immaterial", "pseudo_label", "round", r6(F.col("Immaterial_proba"), "proba"))


@query("j7_score_filings")
def j7(spark, sf):
    model = training.fit_model(training.ModelSpec(), training_rows(spark, sf).persist(), SMALL)
    out = predict.predict_filings(filings(spark, sf), model, 0.6, "Immaterial")
    return out.select("idx", "Immaterial_sents_num", "Immaterial_proba")


@query("j11_score_sentences")
def j11(spark, sf):
    model = training.fit_model(training.ModelSpec(), training_rows(spark, sf).persist(), SMALL)
    talk = load(spark, f"{sf}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.lit(0).alias("pos"), F.col("text").alias("sents")
    )
    return predict.predict_sentences(talk, model, 0.6).select("idx", "proba", "pred")


class ShareModel:
    """Stands in for a fitted model, so that all of scoring but the fit can be checked: probability is the share of keywords."""

    def transform(self, df):
        share = keyword("sents")
        return df.withColumn("probability", array_to_vector(F.array(1 - share, share)))


@query(
    "j7_by_share",
    with_(
        FILINGS, distinct_cut("filings", "cutall"),
        f"seg AS MATERIALIZED (SELECT c.* FROM cutall c JOIN filings n USING (idx) WHERE coalesce({lang('sents')}, {lang('filtered_text')}) = 'en')",
        annotated(), valid(), f"scored AS (SELECT idx, pos, sents, {score('sents', SCORE_WORDS)} AS proba FROM seg JOIN ok USING (idx, pos))", recursive=True,
    )
    + """SELECT idx, string_agg(sents, chr(10) ORDER BY pos) AS Incident_sents, count(*) AS Incident_sents_num, round(avg(proba), 6) AS Incident_proba
FROM scored WHERE proba > 0.3 GROUP BY idx""",
)
def j7_by_share(spark, sf):
    out = predict.predict_filings(filings(spark, sf), ShareModel(), THRESHOLD, "Incident")
    return out.select("idx", "Incident_sents", "Incident_sents_num", r6(F.col("Incident_proba"), "Incident_proba"))


@query(
    "j11_by_share",
    "WITH RECURSIVE talk AS (SELECT conv_id * 1000 + turn AS idx, 0 AS pos, text AS sents FROM conversations), "
    + f"seg AS MATERIALIZED (SELECT * FROM talk WHERE {lang('sents')} = 'en'), " + annotated() + ", " + tagged()
    + f" SELECT idx, round({score('sents', SCORE_WORDS)}, 6) AS proba, CAST({score('sents', SCORE_WORDS)} > 0.3 AS INTEGER) AS pred FROM seg JOIN posf USING (idx, pos)",
)
def j11_by_share(spark, sf):
    talk = load(spark, f"{sf}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.lit(0).alias("pos"), F.col("text").alias("sents")
    )
    return predict.predict_sentences(talk, ShareModel(), THRESHOLD).select("idx", r6(F.col("proba"), "proba"), "pred")
