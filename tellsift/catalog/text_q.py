"""Text, tokens, entities, features and frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tellsift.catalog.registry import filings, labels, notices, query, r6
from tellsift.catalog.sqltext import (
    FILINGS, LABELS, NOTICES, annotated, cut, distinct_cut, inlist, lang, mark, norm, q, replaced, score,
    tagged, valid, with_, words_of,
)
from tellsift.functions import features as X, text as TX, tokens as K, words as W
from tellsift.functions.rules import CLOSE, OPEN
from tellsift.operators import entities as E, frequency as FR, lexicon, scoring, sentences as S
from tellsift.operators.common import computed_struct

# Function words of the documents; they stand in for event words, which invented prose lacks.
SCORE_WORDS = ["the", "of", "and", "to", "that", "with", "for", "from"]


def cut_notices(spark, sf):
    return S.cut_filings(notices(spark, sf), "filtered_text")


def ann_notices(spark, sf):
    return S.with_annotation(cut_notices(spark, sf))


ANN = (NOTICES, cut("notices"), annotated())


def keyword(sents: str = "sents"):
    return scoring.keyword_score(TX_words(F.col(sents)), SCORE_WORDS)


def TX_words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(TX.WORD), F.lit(0))


@query("e1_normalise", with_(FILINGS) + f"SELECT idx, {norm('filtered_text')} AS text FROM filings")
def e1(spark, sf):
    return filings(spark, sf).select("idx", TX.normalise(F.col("filtered_text")).alias("text"))


@query("e2_segment", with_(FILINGS, cut("filings")) + "SELECT idx, pos, sents FROM seg")
def e2(spark, sf):
    return S.cut_filings(filings(spark, sf), "filtered_text").select("idx", "pos", "sents")


@query("e2_segment_lists", with_(NOTICES, cut("notices")) + "SELECT idx, pos, sents FROM seg")
def e2_lists(spark, sf):
    return cut_notices(spark, sf).select("idx", "pos", "sents")


@query(
    "e3_split_lines",
    with_(FILINGS)
    + """SELECT idx, unnest(string_split(filtered_text, chr(10))) AS sents,
CAST(generate_subscripts(string_split(filtered_text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM filings""",
)
def e3(spark, sf):
    return S.cut_filings(filings(spark, sf), "filtered_text", lines=True).select("idx", "sents", "pos")


@query(
    "e4_valid",
    with_(NOTICES, cut("notices"), annotated(), valid(), recursive=True)
    + "SELECT idx, pos, sents FROM seg JOIN ok USING (idx, pos)",
)
def e4(spark, sf):
    ann = ann_notices(spark, sf)
    return ann.where(K.valid_sentence(F.col("ann"))).select("idx", "pos", "sents")


@query("e5_language", with_(FILINGS) + f"SELECT idx, {lang('filtered_text')} AS lang FROM filings")
def e5(spark, sf):
    return filings(spark, sf).select("idx", TX.language(F.col("filtered_text")).alias("lang"))


@query(
    "e5_language_agreement",
    with_(FILINGS)
    + f"SELECT form_type, lang, count(*) AS filings FROM (SELECT form_type, {lang('filtered_text')} AS lang FROM filings) GROUP BY ALL",
)
def e5_agree(spark, sf):
    found = filings(spark, sf).select("form_type", TX.language(F.col("filtered_text")).alias("lang"))
    return found.groupBy("form_type", "lang").agg(F.count("*").alias("filings"))


@query(
    "e6_mentions",
    with_(*ANN, recursive=True)
    + "SELECT idx, pos, CAST(i AS INTEGER) AS token, ent AS label, text FROM ann WHERE ent IS NOT NULL",
)
def e6(spark, sf):
    return E.mentions(ann_notices(spark, sf))


# All places where a name's tokens stand in a sentence's tokens, by comparing lists.
PLACES = """tn AS MATERIALIZED (SELECT DISTINCT label, {words_n} AS l FROM names),
ts AS MATERIALIZED (SELECT idx, pos, {words_s} AS l FROM seg),
places AS MATERIALIZED (SELECT idx, pos, unnest(l) AS w, generate_subscripts(l, 1) AS i, l FROM ts)
SELECT DISTINCT idx, pos, CAST(i - 1 AS INTEGER) AS token, CAST(len(tn.l) AS INTEGER) AS words, label, array_to_string(tn.l, ' ') AS text
FROM places p JOIN tn ON p.w = tn.l[1] AND p.l[i:i + len(tn.l) - 1] = tn.l"""


def places(names: str) -> str:
    def tokens(x):
        return f"regexp_extract_all({mark(x)}, {q(OPEN + '([^' + CLOSE + ']*)' + CLOSE)}, 1)"

    return f"names AS ({names}), " + PLACES.format(words_n=tokens("trim(text)"), words_s=tokens("sents"))


@query(
    "e6_gazetteer",
    with_(NOTICES, cut("notices"), places("""SELECT 'GPE' AS label, n_name AS text FROM nation UNION SELECT 'PLACE', n_name FROM nation
 UNION SELECT 'ORG', c_name FROM customer UNION SELECT 'CASE', n_name || ' v. Acme Holdings, Inc.' FROM nation
 UNION SELECT 'ORG', 'Acme Holdings, Inc.' UNION SELECT 'GOV', 'Securities and Exchange Commission'
 UNION SELECT 'GOV', 'U.S. Department of Justice' UNION SELECT 'SEGMENT', lower(c_mktsegment) || '.com' FROM customer""")),
)
def e6_gazetteer(spark, sf):
    """Places of nations, customers, cases and authorities in the notices; names overlap and hold punctuation."""
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    name = "label string, text string"
    fixed = spark.createDataFrame(
        [("ORG", "Acme Holdings, Inc."), ("GOV", "Securities and Exchange Commission"), ("GOV", "U.S. Department of Justice")], name
    )
    named = [
        nation.select(F.explode(F.array(F.lit("GPE"), F.lit("PLACE"))).alias("label"), F.col("n_name").alias("text")),
        nation.select(F.lit("CASE").alias("label"), F.concat("n_name", F.lit(" v. Acme Holdings, Inc.")).alias("text")),
        customer.select(F.lit("ORG").alias("label"), F.col("c_name").alias("text")),
        customer.select(F.lit("SEGMENT").alias("label"), F.concat(F.lower("c_mktsegment"), F.lit(".com")).alias("text")),
    ]
    for more in named:
        fixed = fixed.unionByName(more)
    return lexicon.name_spans(cut_notices(spark, sf), K.plain_tokens(F.col("sents")), fixed)


@query(
    "e6_quotes",
    with_(FILINGS, cut("filings"), "quoted AS (SELECT item_id AS idx, text AS filtered_text FROM benchmark)", cut("quoted", "qs"),
          places("SELECT 'QUOTE' AS label, sents AS text FROM qs")),
)
def e6_quotes(spark, sf):
    """Every sentence of the benchmark as a name, sought in the sentences of the documents; names of any length."""
    quoted = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("idx"), F.lit("").alias("cik"), F.col("text").alias("filtered_text"))
    names = S.cut_filings(quoted, "filtered_text").select(F.lit("QUOTE").alias("label"), F.col("sents").alias("text"))
    return lexicon.name_spans(S.cut_filings(filings(spark, sf), "filtered_text"), K.plain_tokens(F.col("sents")), names)


@query(
    "e7_org_noise",
    with_(*ANN, recursive=True)
    + f"""SELECT text, len(list_filter(string_split(lower(text), ' '), lambda w: w IN {inlist(W.ORG_NOISE)})) > 0 AS noise, count(*) AS rows
FROM ann WHERE ent = 'ORG' GROUP BY ALL""",
)
def e7(spark, sf):
    orgs = E.mentions(ann_notices(spark, sf)).where("label = 'ORG'")
    counted = orgs.groupBy("text").agg(F.count("*").alias("rows"))
    return counted.select("text", K.is_org_noise(F.col("text")).alias("noise"), "rows")


@query(
    "e8_items",
    with_(*ANN, recursive=True) + "SELECT idx, pos, CAST(i AS INTEGER) AS token, text FROM typed WHERE cls = 'ITEMNUM'",
)
def e8(spark, sf):
    found = E.classes(ann_notices(spark, sf)).where("cls = 'ITEMNUM'")
    return found.select("idx", "pos", "token", "text")


@query(
    "e9_classes",
    with_(*ANN, recursive=True) + "SELECT idx, pos, CAST(i AS INTEGER) AS token, text, cls FROM typed",
)
def e9(spark, sf):
    return E.classes(ann_notices(spark, sf))


def token_query(name, chosen):
    sql = with_(*ANN, replaced(chosen), recursive=True) + (
        "SELECT idx, pos, coalesce(string_agg(tok, ' ' ORDER BY i, j), '') AS tokens FROM seg LEFT JOIN toks USING (idx, pos) GROUP BY idx, pos"
    )

    @query(name, sql)
    def run(spark, sf):
        tokens = F.array_join(K.entity_tokens(F.col("ann"), chosen), " ")
        return ann_notices(spark, sf).select("idx", "pos", tokens.alias("tokens"))


token_query("e10_tokens_current", W.CR_LABELS)
token_query("e10_tokens_periodic", W.PR_LABELS)
token_query("e10_tokens_no_labels", None)


# Words that occur at least this often in the notices make up a vocabulary.
KNOWN = (
    f"voc AS MATERIALIZED (SELECT w FROM (SELECT unnest({words_of('filtered_text')}) AS w FROM notices) GROUP BY w HAVING count(*) > 2000)"
)


def vocabulary(spark, sf):
    words = notices(spark, sf).select(F.explode(TX_words(F.col("filtered_text"))).alias("word"))
    return words.groupBy("word").count().where("count > 2000").select("word")


@query(
    "e10_tokens_with_unknown",
    with_(*ANN, replaced(W.CR_LABELS), KNOWN, recursive=True)
    + """SELECT idx, pos, coalesce(string_agg(CASE WHEN cls = 'WORD' AND tok NOT IN (SELECT w FROM voc) THEN 'OOV' ELSE tok END, ' ' ORDER BY i, j), '') AS tokens
FROM seg LEFT JOIN (toks JOIN typed USING (idx, pos, i)) USING (idx, pos) GROUP BY idx, pos""",
)
def e10_oov(spark, sf):
    """Words that are rare in the notices count as unknown, as do those not in lower case."""
    unknown = E.with_unknown_words(cut_notices(spark, sf), vocabulary(spark, sf))
    tokens = K.entity_tokens(F.col("ann"), W.CR_LABELS, oov=F.col("oov"))
    return S.with_annotation(unknown).select("idx", "pos", F.array_join(tokens, " ").alias("tokens"))


@query("e11_default_tokens", with_(FILINGS, cut("filings")) + "SELECT idx, pos, array_to_string(string_split(sents, ' '), ' ') AS tokens, len(string_split(sents, ' ')) AS n FROM seg")
def e11(spark, sf):
    words = F.split("sents", " ")
    return S.cut_filings(filings(spark, sf), "filtered_text").select(
        "idx", "pos", F.array_join(words, " ").alias("tokens"), F.size(words).cast("bigint").alias("n")
    )


COUNTED = ["URL", "EMAIL", "NUM", "ITEMNUM", *W.CR_LABELS]


@query(
    "e12_entity_counts",
    with_(*ANN, replaced(W.CR_LABELS), recursive=True)
    + "SELECT idx, pos, " + ", ".join(f"count(*) FILTER (tok = '{c}') AS \"{c}\"" for c in COUNTED)
    + " FROM seg LEFT JOIN toks USING (idx, pos) GROUP BY idx, pos",
)
def e12(spark, sf):
    ann = ann_notices(spark, sf)
    tokens = S.computed(ann, words=K.entity_tokens(F.col("ann"), W.CR_LABELS))
    counts = [c.cast("bigint").alias(n) for c, n in zip(X.entity_counts(F.col("words"), W.CR_LABELS), COUNTED)]
    return tokens.select("idx", "pos", *counts)


FREE = f"ent IS NULL AND regexp_matches(text, {q(K.ALPHA)})"


@query(
    "e13_entity_table",
    with_(*ANN, KNOWN, recursive=True)
    + f"""SELECT ent AS label, text FROM ann WHERE ent IS NOT NULL
UNION SELECT 'is_upper', text FROM ann WHERE {FREE} AND regexp_matches(text, '^\\p{{Lu}}+$')
UNION SELECT 'modified_ORG', text FROM ann WHERE ent = 'ORG' AND len(list_filter(string_split(lower(text), ' '), lambda w: w IN {inlist(W.ORG_NOISE)})) = 0
UNION SELECT 'is_oov', text FROM ann WHERE {FREE} AND text NOT IN (SELECT w FROM voc)""",
)
def e13(spark, sf):
    return E.word_entity_table(ann_notices(spark, sf), vocabulary(spark, sf))


POSF = "token_count, VBD_perc, VBN_perc, MD_perc, VERB_perc, NOUN_perc"


@query(
    "e14_to_sentences",
    with_(NOTICES, distinct_cut("notices", "cutall"),
          f"seg AS MATERIALIZED (SELECT c.* FROM cutall c JOIN notices n USING (idx) WHERE coalesce({lang('sents')}, {lang('filtered_text')}) = 'en')",
          annotated(), valid(), replaced(W.CR_LABELS), tagged(), recursive=True)
    + f"""SELECT idx, pos, any_value(cik) AS cik, any_value(sents) AS sents, coalesce(string_agg(tok, ' ' ORDER BY i, j), '') AS tokens,
{', '.join(f'any_value({c}) AS {c}' for c in POSF.split(', '))}
FROM seg JOIN ok USING (idx, pos) JOIN posf USING (idx, pos) LEFT JOIN toks USING (idx, pos) GROUP BY idx, pos""",
)
def e14(spark, sf):
    s = S.to_sentences(notices(spark, sf), "filtered_text", W.CR_LABELS)
    return s.select("idx", "pos", "cik", "sents", "tokens", *[r6(F.col(c), c) for c in X.POS_COLUMNS])


@query(
    "e14_language",
    with_(FILINGS, distinct_cut("filings", "cutall"),
          f"seg AS MATERIALIZED (SELECT c.* FROM cutall c JOIN filings n USING (idx) WHERE coalesce({lang('sents')}, {lang('filtered_text')}) = 'en')",
          annotated(), valid(), recursive=True)
    + "SELECT idx, pos, sents FROM seg JOIN ok USING (idx, pos)",
)
def e14_language(spark, sf):
    """English sentences of the documents, which are in four languages and partly mixed."""
    return S.to_sentences(filings(spark, sf), "filtered_text", W.CR_LABELS).select("idx", "pos", "sents")


@query(
    "e15_add_tokens_pos",
    with_(NOTICES, cut("notices", "cutall"), f"seg AS MATERIALIZED (SELECT * FROM cutall WHERE {lang('sents')} = 'en')",
          annotated(), replaced(W.PR_LABELS), tagged(), recursive=True)
    + f"""SELECT idx, pos, any_value(sents) AS sents, coalesce(string_agg(tok, ' ' ORDER BY i, j), '') AS tokens,
{', '.join(f'any_value({c}) AS {c}' for c in POSF.split(', '))}
FROM seg JOIN posf USING (idx, pos) LEFT JOIN toks USING (idx, pos) GROUP BY idx, pos""",
)
def e15(spark, sf):
    s = S.add_tokens_pos(cut_notices(spark, sf), W.PR_LABELS)
    return s.select("idx", "pos", "sents", "tokens", *[r6(F.col(c), c) for c in X.POS_COLUMNS])


@query(
    "e16_pos",
    with_(NOTICES, cut("notices"), annotated(), tagged(), recursive=True) + f"SELECT idx, pos, {POSF} FROM posf",
)
def e16(spark, sf):
    ann = ann_notices(spark, sf)
    tagged_rows = computed_struct(ann.select("idx", "pos", "ann"), X.pos_features(F.col("ann")))
    return tagged_rows.dropna(subset=["VBD_perc"]).select("idx", "pos", *[r6(F.col(c), c) for c in X.POS_COLUMNS])


def sentiment_sql(source: str, base: str) -> str:
    pol = " ".join(f"WHEN w IN {inlist(g)} THEN {p}" for p, _, g in W.SENTIMENT)
    sub = " ".join(f"WHEN w IN {inlist(g)} THEN {s}" for _, s, g in W.SENTIMENT)
    boost = " ".join(f"WHEN b1 IN {inlist(g)} THEN {m}" for m, g in W.INTENSIFIERS)
    known = inlist([w for _, _, g in W.SENTIMENT for w in g])
    boosters = inlist([w for _, g in W.INTENSIFIERS for w in g])
    from tellsift.catalog.sqltext import mark
    from tellsift.functions.rules import CLOSE, OPEN

    tokens = f"regexp_extract_all({mark('sents')}, {q(OPEN + '([^' + CLOSE + ']*)' + CLOSE)}, 1)"
    return with_(
        base, cut(source),
        f"tl AS (SELECT idx, pos, {tokens} AS l FROM seg)",
        "tw AS (SELECT idx, pos, lower(unnest(l)) AS w, generate_subscripts(l, 1) AS i FROM tl)",
        "tb AS (SELECT *, lag(w) OVER o AS b1, lag(w, 2) OVER o AS b2 FROM tw WINDOW o AS (PARTITION BY idx, pos ORDER BY i))",
        f"""hit AS (SELECT idx, pos, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (CASE {pol} END)::DOUBLE * (CASE {boost} ELSE 1.0 END)::DOUBLE
 * (CASE WHEN (CASE WHEN b1 IN {boosters} THEN b2 ELSE b1 END) IN {inlist(W.NEGATIONS)} THEN -0.5 ELSE 1.0 END)::DOUBLE)) AS p,
 (CASE {sub} END)::DOUBLE AS s FROM tb WHERE w IN {known})""",
    ) + """SELECT idx, pos, coalesce(round(avg(p), 6), 0) AS polarity, coalesce(round(avg(s), 6), 0) AS subjectivity
FROM seg LEFT JOIN hit USING (idx, pos) GROUP BY idx, pos"""


@query("e17_sentiment", sentiment_sql("filings", FILINGS))
def e17(spark, sf):
    cut_rows = S.cut_filings(filings(spark, sf), "filtered_text").select("idx", "pos", "sents")
    s = computed_struct(cut_rows, X.sentence_sentiment(F.col("sents")))
    return s.select("idx", "pos", *[r6(F.col(c), c) for c in X.SENTIMENT_COLUMNS])


@query("e17_sentiment_notices", sentiment_sql("notices", NOTICES))
def e17_notices(spark, sf):
    s = computed_struct(cut_notices(spark, sf).select("idx", "pos", "sents"), X.sentence_sentiment(F.col("sents")))
    return s.select("idx", "pos", *[r6(F.col(c), c) for c in X.SENTIMENT_COLUMNS])


@query("e17_sentiment_by_join", sentiment_sql("notices", NOTICES))
def e17_join(spark, sf):
    """The same with the lexicon as a table."""
    rows = [(w, float(p), float(s)) for p, s, group in W.SENTIMENT for w in group]
    table = spark.createDataFrame(rows, "word string, polarity double, subjectivity double")
    words = F.transform(K.plain_tokens(F.col("sents")), F.lower)
    s = lexicon.sentiment_by_join(cut_notices(spark, sf).select("idx", "pos", "sents"), words, table)
    return s.select("idx", "pos", *[r6(F.col(c), c) for c in X.SENTIMENT_COLUMNS])


@query(
    "e18_length",
    with_(FILINGS, cut("filings"), "w AS (SELECT idx, pos, string_split(sents, ' ') AS l FROM seg)",
          "m AS (SELECT idx, pos, length(array_to_string(l, '')) AS c, len(l) AS n, len(list_distinct(l)) AS u FROM w)")
    + """SELECT idx, pos, round(ln(c + 1), 6) AS char_count, round(c / n, 6) AS avg_word_length,
round(ln(u + 1), 6) AS unique_count, round(u / n, 6) AS unique_vs_words FROM m""",
)
def e18(spark, sf):
    cut_rows = S.cut_filings(filings(spark, sf), "filtered_text").select("idx", "pos", "sents")
    s = computed_struct(cut_rows, X.length_features(F.col("sents")))
    return s.select("idx", "pos", *[r6(F.col(c), c) for c in X.LENGTH_COLUMNS])


def gram_sql(n: int, stop=None, lower: bool = True) -> str:
    """``g(idx, pos, word)``: n-grams of the default words of every sentence."""
    text = "lower(sents)" if lower else "sents"
    words = f"regexp_extract_all({text}, {q('[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]{2,}')})"
    if stop:
        words = f"list_filter({words}, lambda w: w NOT IN {inlist(stop)})"
    gram = "l[k:k + %d]" % (n - 1)
    return (
        f"gw AS (SELECT idx, pos, {words} AS l FROM seg), "
        f"g AS (SELECT idx, pos, array_to_string({gram}, ' ') AS word FROM "
        f"(SELECT idx, pos, l, unnest(range(1, len(l) - {n - 1} + 1)) AS k FROM gw))"
    )


def top_query(name: str, n: int, stop=None):
    sql = with_(FILINGS, cut("filings"), gram_sql(n, stop)) + (
        "SELECT word, round(count(*) / (SELECT count(*) FROM seg) * 1000, 6) AS freq FROM g GROUP BY word ORDER BY count(*) DESC, word LIMIT 100"
    )

    @query(name, sql)
    def run(spark, sf):
        cut_rows = S.cut_filings(filings(spark, sf), "filtered_text").select("sents")
        top = FR.top_words(cut_rows, FR.gram_array(F.col("sents"), n, stop=stop), 100)
        return top.select("word", r6(F.col("freq"), "freq"))


top_query("e19_top_words", 1)
top_query("e22_without_stop_words", 1, W.CR_STOP_LOWER)
top_query("e22_bigrams_without_stop_words", 2, W.PR_STOP_LOWER)


def compare_query(name: str, n: int, top: int = 100):
    groups = {"avg_all": "true"}
    for key in ("Incident", "Immaterial"):
        groups[f"{key}_pos"] = f"{key} = 1"
        groups[f"{key}_neg"] = f"{key} = 0"
    counts = ", ".join(f"count(*) FILTER ({c}) AS {g}" for g, c in groups.items())
    tops = ", ".join(
        f"t_{g} AS (SELECT word, {g} / (SELECT count(*) FILTER ({c}) FROM seg JOIN lab USING (idx)) * 1000 AS f FROM cnt "
        f"WHERE {g} > 0 ORDER BY {g} DESC, word LIMIT {top})"
        for g, c in groups.items()
    )
    joins = " FULL JOIN ".join(
        f"(SELECT word AS words, f AS {g} FROM t_{g}) x_{g}" + ("" if g == "avg_all" else " USING (words)") for g in groups
    )
    sql = with_(
        FILINGS, LABELS, cut("filings"), gram_sql(n), f"cnt AS MATERIALIZED (SELECT word, {counts} FROM g JOIN lab USING (idx) GROUP BY word)", tops
    ) + f"SELECT words, {', '.join(f'round({g}, 6) AS {g}' for g in groups)} FROM {joins}"

    @query(name, sql)
    def run(spark, sf):
        f = filings(spark, sf).join(labels(spark, sf), "idx")
        s = S.cut_filings(f, "filtered_text")
        table = FR.compare_top_words(s, FR.gram_array(F.col("sents"), n), ["Incident", "Immaterial"], top)
        return table.select("words", *[r6(F.col(g), g) for g in groups])


compare_query("e20_compare", 1)
compare_query("e21_bigrams", 2)
compare_query("e21_trigrams", 3)


@query(
    "c2_full_words",
    with_(
        FILINGS, LABELS, cut("filings"), gram_sql(1),
        "p AS (SELECT word, count(*) AS pos FROM g JOIN lab USING (idx) WHERE Incident = 1 GROUP BY word ORDER BY pos DESC, word LIMIT 100)",
        "n AS (SELECT word, count(*) AS neg FROM g JOIN lab USING (idx) WHERE Incident = 0 GROUP BY word ORDER BY neg DESC, word LIMIT 100)",
    )
    + """SELECT coalesce(p.word, n.word) AS word, round(pos / (SELECT count(*) FROM seg JOIN lab USING (idx) WHERE Incident = 1) * 1000, 6) AS freq_pos,
round(neg / (SELECT count(*) FROM seg JOIN lab USING (idx) WHERE Incident = 0) * 1000, 6) AS freq_neg FROM p FULL JOIN n ON p.word = n.word""",
)
def c2(spark, sf):
    s = S.cut_filings(filings(spark, sf).join(labels(spark, sf), "idx"), "filtered_text")
    words = FR.gram_array(F.col("sents"), 1)
    pos = FR.top_words(s.where("Incident = 1"), words, 100).withColumnRenamed("freq", "freq_pos")
    neg = FR.top_words(s.where("Incident = 0"), words, 100).withColumnRenamed("freq", "freq_neg")
    return pos.join(neg, "word", "full").select(
        "word", r6(F.col("freq_pos"), "freq_pos"), r6(F.col("freq_neg"), "freq_neg")
    )
