"""Sources, filters, joins, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellsift.catalog.registry import filings, labels, load, query, r6
from tellsift.catalog.sqltext import FILINGS, LABELS, with_
from tellsift.operators import chunks, ranks, results, sampling, tables as T
from tellsift.sources import aligned, tables as S


def labelled(spark, sf):
    return filings(spark, sf).join(labels(spark, sf), "idx", "left")


LABELLED = (
    FILINGS, LABELS,
    "d AS (SELECT f.*, Incident, Immaterial FROM filings f LEFT JOIN lab USING (idx))",
)


@query(
    "a2_union_by_name",
    with_(FILINGS)
    + """SELECT idx, filtered_text AS text, form_type, NULL AS role FROM filings WHERE form_type = 'en'
UNION ALL SELECT idx, filtered_text, form_type, NULL FROM filings WHERE form_type = 'fr'
UNION ALL SELECT conv_id * 1000 + turn, text, NULL, role FROM conversations""",
)
def a2(spark, sf):
    f = filings(spark, sf).withColumnRenamed("filtered_text", "text").drop("cik")
    talk = load(spark, f"{sf}/conversations.parquet").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "text", "role"
    )
    return T.union_by_name(f.where("form_type = 'en'"), f.where("form_type = 'fr'"), talk).select(
        "idx", "text", "form_type", "role"
    )


FORM_OF = "(CASE o_orderstatus WHEN 'F' THEN '8-K' WHEN 'O' THEN '10-K' ELSE 'S-1' END)"


def order_files(spark, sf):
    """One file name per order, as a stand-in for file listings."""
    form = F.when(F.col("o_orderstatus") == "F", "8-K").when(F.col("o_orderstatus") == "O", "10-K").otherwise("S-1")
    return load(spark, f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("idx"),
        F.concat(F.lit("in/breach_"), form, F.lit("_"), F.year("o_orderdate").cast("string"), F.lit(".csv")).alias("path"),
    )


@query(
    "a3_files_by_form_and_year",
    f"""SELECT form_type, year, count(*) AS files FROM (SELECT {FORM_OF} AS form_type,
CAST(year(o_orderdate) AS INTEGER) AS year FROM orders) WHERE form_type IN ('8-K', '10-K') AND year = 1995 GROUP BY ALL""",
)
def a3(spark, sf):
    parts = S.file_parts(order_files(spark, sf))
    return (
        parts.where(F.col("form_type").isin("8-K", "10-K") & (F.col("year") == 1995))
        .groupBy("form_type", "year")
        .agg(F.count("*").alias("files"))
    )


@query(
    "a4_form_group",
    f"""SELECT CASE WHEN form_type IN ('6-K', '8-K') THEN 'CR' ELSE 'PR' END AS form_label, form_type, count(*) AS filings
FROM (SELECT {FORM_OF} AS form_type FROM orders) GROUP BY ALL""",
)
def a4(spark, sf):
    grouped = T.with_form_group(S.file_parts(order_files(spark, sf)).drop("year", "tag"))
    return grouped.groupBy("form_label", "form_type").agg(F.count("*").alias("filings"))


def summary(spark, sf):
    """A model summary derived from labels: per source a threshold for either metric."""
    d = labelled(spark, sf).where("Incident is not null")
    return d.groupBy(F.col("cik").alias("model_name")).agg(
        F.avg("Incident").alias("threshold_f1"), F.avg("Immaterial").alias("threshold_gm")
    )


SUMMARY = (*LABELLED, """s AS (SELECT cik AS model_name, avg(Incident) AS threshold_f1,
avg(Immaterial) AS threshold_gm FROM d WHERE Incident IS NOT NULL GROUP BY cik)""")


@query(
    "a6_stack_summary",
    with_(*SUMMARY)
    + """SELECT model_name, round(threshold_f1, 6) AS threshold_f1, round(threshold_gm, 6) AS threshold_gm FROM s
UNION ALL SELECT model_name, round(threshold_f1, 6), NULL FROM s WHERE threshold_f1 > 0.8""",
)
def a6(spark, sf):
    s = summary(spark, sf)
    old = s.where("threshold_f1 > 0.8").drop("threshold_gm")
    return results.stack_summary(s, old).select(
        "model_name", r6(F.col("threshold_f1"), "threshold_f1"), r6(F.col("threshold_gm"), "threshold_gm")
    )


@query(
    "a8_stored_threshold",
    with_(*SUMMARY) + "SELECT round(threshold_gm, 6) AS threshold FROM s WHERE model_name = 'src3'",
)
def a8(spark, sf):
    return T.stored_threshold(summary(spark, sf), "src3", "gm").select(r6(F.col("threshold"), "threshold"))


@query("b1_with_text", with_(FILINGS) + "SELECT idx, cik FROM filings WHERE filtered_text IS NOT NULL")
def b1(spark, sf):
    return T.with_text(filings(spark, sf)).select("idx", "cik")


@query(
    "b2_fill_labels",
    with_(*LABELLED) + "SELECT idx, coalesce(Incident, 0) AS Incident, coalesce(Immaterial, -1) AS Immaterial FROM d",
)
def b2(spark, sf):
    d = labelled(spark, sf).select("idx", "Incident", "Immaterial")
    return T.fill_labels(T.fill_labels(d, ["Incident"], 0), ["Immaterial"], -1)


@query("b3_dedup", with_(FILINGS) + "SELECT DISTINCT cik, form_type, filtered_text FROM filings")
def b3(spark, sf):
    return filings(spark, sf).select("cik", "form_type", "filtered_text").dropDuplicates()


@query("b4_drop_features", with_(*LABELLED) + "SELECT idx, form_type FROM d")
def b4(spark, sf):
    d = labelled(spark, sf)
    return d.select(*T.feature_columns(d, ["cik", "Incident", "Immaterial", "filtered_text", "Cost"]))


@query(
    "b5_semi",
    with_(FILINGS, LABELS)
    + """SELECT idx, cik FROM filings WHERE form_type IN ('en', 'de') AND cik IN
(SELECT cik FROM filings JOIN lab USING (idx) WHERE Immaterial = 1)""",
)
def b5(spark, sf):
    f = filings(spark, sf)
    wanted = f.join(labels(spark, sf).where("Immaterial = 1"), "idx", "left_semi")
    return T.keep_members(f.where(F.col("form_type").isin("en", "de")), wanted).select("idx", "cik")


@query("b6_distinct_keys", with_(FILINGS) + "SELECT DISTINCT cik FROM filings WHERE cik IS NOT NULL")
def b6(spark, sf):
    return T.distinct_firms(filings(spark, sf))


@query(
    "b7_split_by_label",
    with_(*LABELLED)
    + "SELECT count(*) FILTER (Incident = 1) AS positive, count(*) FILTER (Incident = 0) AS negative FROM d",
)
def b7(spark, sf):
    return labelled(spark, sf).agg(
        F.count_if(F.col("Incident") == 1).alias("positive"), F.count_if(F.col("Incident") == 0).alias("negative")
    )


MASTER = (*LABELLED, "m AS (SELECT *, CASE WHEN contains(filtered_text, chr(10)) THEN filtered_text END AS sents FROM d)")


def master(spark, sf):
    """Filings of which those with several lines already have sentences."""
    cut = F.when(F.col("filtered_text").contains("\n"), F.col("filtered_text"))
    return labelled(spark, sf).withColumn("sents", cut)


@query(
    "b8_unlabelled",
    with_(*MASTER)
    + """SELECT cik, md5(filtered_text) AS text_md5, label FROM (
SELECT cik, filtered_text, 'Incident' AS label FROM m WHERE Incident = 1 AND sents IS NULL AND form_type IN ('en', 'fr')
UNION ALL SELECT cik, filtered_text, 'Immaterial' FROM m WHERE Immaterial = 1 AND sents IS NULL AND form_type IN ('en', 'fr'))""",
)
def b8(spark, sf):
    return T.unlabelled_filings(master(spark, sf), ["en", "fr"]).select(
        "cik", F.md5("filtered_text").alias("text_md5"), "label"
    )


@query(
    "b9_blank_labels",
    with_(FILINGS) + "SELECT idx, '' AS Incident, '' AS Immaterial, '' AS Cost, '' AS Litigation, '' AS Management FROM filings",
)
def b9(spark, sf):
    return sampling.blank_labels(filings(spark, sf).select("idx"))


@query("b10_key_to_string", "SELECT CAST(o_custkey AS VARCHAR) AS cik, count(*) AS filings FROM orders GROUP BY 1")
def b10(spark, sf):
    return (
        load(spark, f"{sf}/orders.parquet")
        .groupBy(F.col("o_custkey").cast("string").alias("cik"))
        .agg(F.count("*").alias("filings"))
    )


@query("b11_rename", with_(*LABELLED) + "SELECT idx, Incident AS true_label, Immaterial AS Incident FROM d")
def b11(spark, sf):
    d = labelled(spark, sf).drop("cik", "form_type", "filtered_text")
    return d.withColumnsRenamed({"Incident": "true_label", "Immaterial": "Incident"})


@query(
    "c4_aligned",
    """WITH a AS (SELECT row_number() OVER () - 1 AS position, doc_id, n_chars FROM documents),
b AS (SELECT row_number() OVER () - 1 AS position, page_id, url FROM pages)
SELECT coalesce(a.position, b.position) AS position, doc_id, n_chars, page_id, url FROM a FULL JOIN b ON a.position = b.position""",
)
def c4(spark, sf):
    docs = aligned.read_with_position(spark, f"{sf}/documents.parquet").select("position", "doc_id", "n_chars")
    pages = aligned.read_with_position(spark, f"{sf}/pages.parquet").select("position", "page_id", "url")
    return aligned.side_by_side(docs, pages)


@query(
    "c3_natural_full",
    with_(*LABELLED)
    + """, n AS (SELECT idx, cik, Incident, 1 AS Incident_num FROM d WHERE form_type IN ('en', 'fr')),
o AS (SELECT idx, cik, Incident, 2 AS Related_num FROM d WHERE form_type IN ('fr', 'es', 'de'))
SELECT coalesce(n.idx, o.idx) AS idx, coalesce(n.cik, o.cik) AS cik, coalesce(n.Incident, o.Incident) AS Incident, Incident_num, Related_num
FROM n FULL JOIN o ON n.idx = o.idx AND n.cik = o.cik AND n.Incident IS NOT DISTINCT FROM o.Incident""",
)
def c3(spark, sf):
    d = labelled(spark, sf)
    new = d.where("form_type in ('en', 'fr')").select("idx", "cik", "Incident", F.lit(1).alias("Incident_num"))
    old = d.where("form_type in ('fr', 'es', 'de')").select("idx", "cik", "Incident", F.lit(2).alias("Related_num"))
    return T.natural_full(new, old)


@query(
    "c6_bag_union",
    with_(FILINGS)
    + "SELECT source, count(*) AS rows FROM (SELECT cik AS source FROM filings UNION ALL SELECT role FROM conversations UNION ALL SELECT cik FROM filings) GROUP BY 1",
)
def c6(spark, sf):
    f = filings(spark, sf).select(F.col("cik").alias("source"))
    talk = load(spark, f"{sf}/conversations.parquet").select(F.col("role").alias("source"))
    return T.union_by_name(f, talk, f).groupBy("source").agg(F.count("*").alias("rows"))


def h(seed, *cols):
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws('|', {parts}, '{seed}'))"


ONE = f"""one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY {h(2021, 'idx')}, idx) AS r
FROM filings WHERE filtered_text IS NOT NULL) WHERE r = 1)"""


@query("d1_one_per_firm", with_(FILINGS, ONE) + f"SELECT idx, cik, md5(filtered_text) AS text_md5 FROM one ORDER BY {h(2022, 'idx')}, idx LIMIT 12")
def d1(spark, sf):
    sample, _ = sampling.sample_firms(filings(spark, sf), nmax=12)
    return sample.select("idx", "cik", F.md5("filtered_text").alias("text_md5"))


@query("d1_firm_share", with_(FILINGS, ONE) + "SELECT count(*) AS unique_firms, round(least(count(*), 12) / count(*), 6) AS select_per FROM one")
def d1_share(spark, sf):
    _, stats = sampling.sample_firms(filings(spark, sf), nmax=12)
    return stats.select("unique_firms", r6(F.col("select_per"), "select_per"))


@query("d2_top_n_sample", with_(FILINGS) + f"SELECT idx, cik FROM filings ORDER BY {h(2021, 'idx')}, idx LIMIT 110")
def d2(spark, sf):
    return sampling.top_sample(filings(spark, sf), 110, "idx").select("idx", "cik")


FIRM_LINES = """l AS (SELECT idx, cik, unnest(string_split(filtered_text, chr(10))) AS sents,
CAST(generate_subscripts(string_split(filtered_text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM filings)"""


def firm_lines(spark, sf):
    from tellsift.operators.sentences import cut_filings

    return cut_filings(filings(spark, sf), "filtered_text", lines=True).select("idx", "cik", "pos", "sents")


@query(
    "d3_n_per_firm",
    with_(FILINGS, FIRM_LINES)
    + f"""SELECT idx, cik, pos, sents, '' AS Incident, '' AS Immaterial, '' AS Cost, '' AS Litigation, '' AS Management FROM
(SELECT *, row_number() OVER (PARTITION BY cik ORDER BY {h(42, 'idx', 'pos')}, idx, pos) AS r FROM l) WHERE r <= 4 ORDER BY cik""",
)
def d3(spark, sf):
    return sampling.sentences_per_firm(firm_lines(spark, sf), nsents=4)


@query(
    "d4_file_sample",
    with_(FILINGS)
    + f""", one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form_type, cik ORDER BY {h(2021, 'idx')}, idx) AS r
FROM filings WHERE filtered_text IS NOT NULL) WHERE r = 1)
SELECT idx, cik, form_type FROM (SELECT *, row_number() OVER (PARTITION BY form_type ORDER BY {h(2022, 'idx')}, idx) AS r2 FROM one) WHERE r2 <= 11""",
)
def d4(spark, sf):
    sample, _ = sampling.sample_files(filings(spark, sf), nmax=11, file_col="form_type")
    return sample.select("idx", "cik", "form_type")


@query(
    "d4_restarting_ids",
    with_(FILINGS)
    + f""", numbered AS (SELECT row_number() OVER (PARTITION BY form_type ORDER BY idx) AS idx, cik, form_type, filtered_text FROM filings),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY form_type, cik ORDER BY {h(2021, 'idx')}, idx) AS r
FROM numbered WHERE filtered_text IS NOT NULL) WHERE r = 1)
SELECT idx, cik, form_type FROM (SELECT *, row_number() OVER (PARTITION BY form_type ORDER BY {h(2022, 'idx')}, idx) AS r2 FROM one) WHERE r2 <= 11""",
)
def d4_restart(spark, sf):
    """The same sample where every file numbers its filings from 1."""
    restarted = ranks.numbered(filings(spark, sf), ["form_type"], ["idx"], "idx")
    sample, _ = sampling.sample_files(restarted, nmax=11, file_col="form_type")
    return sample.select("idx", "cik", "form_type")


@query(
    "d4_file_stats",
    with_(FILINGS)
    + "SELECT form_type, count(DISTINCT cik) AS unique_firms, round(least(count(DISTINCT cik), 11) / count(DISTINCT cik), 6) AS select_per FROM filings GROUP BY 1",
)
def d4_stats(spark, sf):
    _, stats = sampling.sample_files(filings(spark, sf), nmax=11, file_col="form_type")
    return stats.select("form_type", "unique_firms", r6(F.col("select_per"), "select_per"))


@query("d5_repeat_firms", "SELECT count(*) - count(DISTINCT o_custkey) AS duplicate_firms FROM orders")
def d5(spark, sf):
    orders = load(spark, f"{sf}/orders.parquet").select(F.col("o_custkey").cast("string").alias("cik"))
    return sampling.repeated_firms(orders)


@query("d6_sort_by_key", with_(FILINGS) + "SELECT cik, idx FROM filings ORDER BY cik, idx")
def d6(spark, sf):
    return filings(spark, sf).select("cik", "idx").orderBy("cik", "idx")


@query(
    "d7_sentence_histogram",
    with_(FILINGS, FIRM_LINES)
    + """SELECT CAST(CASE WHEN n < 0 THEN 0 WHEN n >= 100 THEN 11 ELSE floor(n / 10.0) + 1 END AS INTEGER) AS bin, count(*) AS rows
FROM (SELECT idx, count(*) AS n FROM l GROUP BY idx) GROUP BY 1""",
)
def d7(spark, sf):
    f = filings(spark, sf).select(F.size(F.split("filtered_text", "\n")).alias("n"))
    return sampling.histogram(f, "n", 0.0, 100.0, 10)


RANKED = f"""r AS (SELECT idx, Incident, row_number() OVER (PARTITION BY Incident ORDER BY {h(2021, 'idx')}, idx) AS rank,
count(*) OVER (PARTITION BY Incident) AS n FROM lab)"""


@query(
    "d8_split",
    with_(LABELS, RANKED) + "SELECT idx, Incident, CASE WHEN rank <= round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r",
)
def d8(spark, sf):
    return sampling.stratified_split(labels(spark, sf).select("idx", "Incident"), "Incident", "idx")


@query("d9_folds", with_(LABELS, RANKED) + "SELECT idx, Incident, CAST((rank - 1) % 3 AS INTEGER) AS fold FROM r")
def d9(spark, sf):
    return sampling.stratified_folds(labels(spark, sf).select("idx", "Incident"), "Incident", "idx")


@query("d10_undersample", with_(LABELS, RANKED) + "SELECT idx, Incident FROM r WHERE rank <= (SELECT min(n) FROM r)")
def d10_under(spark, sf):
    return sampling.undersample(labels(spark, sf).select("idx", "Incident"), "Incident", "idx")


@query(
    "d10_oversample",
    with_(LABELS, RANKED)
    + """SELECT idx, Incident, CAST(unnest(range(1, (SELECT max(n) FROM r) // n + CASE WHEN rank <= (SELECT max(n) FROM r) % n THEN 1 ELSE 0 END + 1)) AS INTEGER) AS copy FROM r""",
)
def d10_over(spark, sf):
    return sampling.oversample(labels(spark, sf).select("idx", "Incident"), "Incident", "idx")


@query(
    "d11_exact_rank",
    f"SELECT o_orderkey AS idx, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {h(7, 'o_orderkey')}, o_orderkey) AS rank FROM orders",
)
def d11(spark, sf):
    o = load(spark, f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("idx"), "o_orderstatus")
    ranked = ranks.exact_rank(o.withColumn("h", ranks.order_key(7, "idx")), ["o_orderstatus"], "h", ["idx"])
    return ranked.select("idx", "o_orderstatus", "rank")


@query(
    "x13_own_function",
    """SELECT doc_id AS idx, CASE WHEN len(l) > 1 THEN l[2] END AS line, CASE WHEN len(l) > 1 THEN NULL
 WHEN l IS NULL THEN 'TypeError: no text' ELSE 'ValueError: only one line' END AS error
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
)
def x13(spark, sf):
    """A function of one's own over all documents, the rows on which it fails beside the others."""

    def second(text):
        if text is None:
            raise TypeError("no text")
        lines = text.split("\n")
        if len(lines) < 2:
            raise ValueError("only one line")
        return lines[1]

    def function(chunk):
        return chunk.assign(line=[second(t) for t in chunk["filtered_text"]])

    done, failed = chunks.map_chunks(filings(spark, sf), function, "line string")
    return done.unionByName(failed, allowMissingColumns=True)
