"""Segmentation, tokens, entities and features on small texts of our own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tellsift.functions import features as X, text as T, tokens as K, words as W
from tellsift.functions.rules import Rule, default_rules
from tellsift.operators import entities as E, lexicon, sentences as S
from tellsift.session import cut_lineage

CLAUSE = (
    "A pump stands idle where: (i) the float (unless it sticks in mud) drops under the red line; (ii) a fitter "
    "shuts the valve by hand; or (iii) the river floods the shed."
)
RELEASE = (
    "Heavy rain flooded the harbour of Quill Freight (NYSE: QFRT) in the north on April 9, 2017. "
    "The crews of Quill Freight are fed by 240 cooks and over 30 bakers. "
    "The timetable is kept at www.quill-freight.com."
)
TITLE = "After (i) a survey of the lot, (ii) a map of its fences and (iii) the fee, the clerk closes the file."
SECTION = "Tenants share the cost of lamps as Section 7(c) of the lease says."


def rows(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    return [r[0] for r in df.orderBy("id").select(column(F.col("t"))).collect()]


def one(spark, text, column):
    return rows(spark, [text], column)[0]


def test_normalise(spark):
    out = rows(spark, ["a\n b\t　c \\99 d\x85e ", "", None, "x\x99y"], T.normalise)
    assert out == ["a b c d e", "", None, "x\x99y"]


def test_segments_of_lists_and_brackets(spark):
    cut = rows(spark, [CLAUSE, RELEASE, TITLE, SECTION], lambda c: T.segment(T.normalise(c)))
    assert [len(c) for c in cut] == [4, 3, 1, 1]
    assert cut[0][1].startswith("(i) the float (unless it sticks") and cut[0][2].endswith("or")


def test_abbreviations_end_no_sentence(spark):
    text = "See File No. Seven v. Eight in the U.S. Court. He met Mr. Poe (Dr. Who. Yes) there. End"
    assert one(spark, text, T.segment) == [
        "See File No. Seven v. Eight in the U.S. Court.", "He met Mr. Poe (Dr. Who. Yes) there.", "End",
    ]


def test_language(spark):
    texts = ["the cat is in the house", "der Hund ist nicht hier", "el perro es de la casa y no", "le chat est dans la maison", "xyz", ""]
    assert rows(spark, texts, T.language) == ["en", "de", "es", "fr", None, None]


@pytest.mark.parametrize(
    "text, label, found",
    [
        ("(NASDAQ: ABCD)", "TICKER", "(NASDAQ: ABCD)"),
        ("(NYSE: AB, NASDAQ: CD)", "TICKER", "(NYSE: AB, NASDAQ: CD)"),
        ("the Tax Court", "GOV", "the Tax Court"),
        ("our non-GAAP measures", "ACCT", "non-GAAP"),
        ("Dayton, OH 45402 USA", "GPE", "Dayton, OH 45402 USA"),
        ("filed on Form 8-K today", "FILING", "Form 8-K"),
        ("the Securities and Exchange Commission ruled", "SEC", "the Securities and Exchange Commission"),
        ("EU regulators met", "GPE", "EU regulators"),
        ("on March 4, 2011 we", "DATE", "March 4, 2011"),
        ("about 12% of", "PERCENT", "12%"),
        ("paid $5.3 million in cash", "MONEY", "$5.3 million"),
    ],
)
def test_entities(spark, text, label, found):
    ents = [(t.ent, t.text) for t in one(spark, text, lambda c: K.annotate("t")) if t.ent]
    assert ents == [(label, found)]


def test_longer_entity_wins_and_eu_needs_no_title(spark):
    ents = [(t.ent, t.text) for t in one(spark, "the U.S. Department of Justice and EU Council", lambda c: K.annotate("t")) if t.ent]
    assert ents == [("GOV", "the U.S. Department of Justice")]


def test_tokens_keep_words_once(spark):
    texts = [CLAUSE, RELEASE, TITLE, "mail a.b@c.org, see https://x.y/z?q=1. It's 9,000"]
    for text, tokens in zip(texts, rows(spark, texts, lambda c: K.annotate("t"))):
        assert "".join(t.text for t in tokens).replace(" ", "") == text.replace(" ", "")


def test_item_markers(spark):
    def items(text):
        tokens = one(spark, text, lambda c: K.annotate("t"))
        df = spark.createDataFrame([(1, [(t.i, t.text, t.ent) for t in tokens])], "id int, ann array<struct<i:int,text:string,ent:string>>")
        flags = F.transform(F.col("ann"), lambda t, i: K.is_item(F.col("ann"), i))
        return [t.text for t, hit in zip(tokens, df.select(flags).first()[0]) if hit]

    assert [items(f"({x})") for x in ("a", "iv", "3", "xxxi", "ccc")] == [["a"], ["iv"], ["3"], ["xxxi"], ["ccc"]]
    assert items("a)") == [] and items("(34) and (ab)") == []


def test_entity_tokens(spark):
    def tokens(text, labels):
        return one(spark, text, lambda c: T.let(K.annotate("t"), lambda a: K.entity_tokens(a, labels)))

    assert tokens("On May 3, 2014 two of (a) x@y.org see www.a.com", W.CR_LABELS) == [
        "On", "DATE", "NUM", "of", "ITEMNUM", "EMAIL", "see", "URL",
    ]
    assert tokens("Acme Holdings, Inc. met Data Agreement Corp.", ["ORG"]) == ["ORG", "met", "Data", "Agreement"]
    assert tokens("paid $5 million in May 2014", None) == ["paid", "million", "in", "May"]


def test_valid_sentence(spark):
    texts = ["12% 7 $88 9% $3", "Tariff’ denotes", "(q) Spare Parts.", RELEASE, "a an of to in by"]
    assert rows(spark, texts, lambda c: T.let(K.annotate("t"), K.valid_sentence)) == [False, False, False, True, False]


def test_lengths(spark):
    out = one(spark, "a bb  a", X.length_features)
    assert out.char_count == pytest.approx(math.log(5)) and out.avg_word_length == 1.0
    assert out.unique_count == pytest.approx(math.log(4)) and out.unique_vs_words == 0.75


def test_pos(spark):
    out = one(spark, RELEASE.split(". ")[0], lambda c: T.let(K.annotate("t"), X.pos_features))
    n = math.expm1(out.token_count)
    assert round(out.VERB_perc * n) == 1 and round(out.VBD_perc * n) == 1
    perfect = one(spark, "Data has not been stolen and was recently accessed; we may sue", lambda c: T.let(K.annotate("t"), X.pos_features))
    n = math.expm1(perfect.token_count)
    assert round(perfect.VBN_perc * n) == 3 and round(perfect.MD_perc * n) == 1
    assert one(spark, "( ) ;", lambda c: T.let(K.annotate("t"), X.pos_features)).VBD_perc is None


def test_sentiment(spark):
    out = rows(spark, ["a good day", "not good", "a very good day", "not very good", "plain"], X.sentence_sentiment)
    assert [round(o.polarity, 6) for o in out] == [0.5, -0.25, 0.65, -0.325, 0.0]
    assert [o.subjectivity for o in out] == [0.6, 0.6, 0.6, 0.6, 0.0]


def test_ngrams_against_brute_force(spark):
    rng = random.Random(1)
    lists = [[rng.choice("abc") for _ in range(rng.randrange(6))] for _ in range(20)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "id int, w array<string>")
    out = df.orderBy("id").select(K.ngrams(F.col("w"), 1, 3)).collect()
    for words, row in zip(lists, out):
        assert row[0] == [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_to_sentences(spark):
    df = spark.createDataFrame([(1, RELEASE + " " + RELEASE, "7"), (2, None, "8")], "idx long, filtered_text string, cik string")
    out = S.to_sentences(df, labels=W.CR_LABELS)
    assert out.columns == ["idx", "cik", "pos", "sents", "tokens", *X.POS_COLUMNS]
    assert [r.pos for r in out.orderBy("pos").collect()] == [0, 1, 2]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "partitioning" not in plan.lower()


def test_language_is_tested_per_sentence(spark):
    english = "The hackers stole the records of the clinic and sold them to a broker."
    german = "Die Daten der Klinik sind in der Nacht von einem Dieb kopiert worden. Das Haus ist nicht mehr sicher und die Akten fehlen."
    df = spark.createDataFrame([(1, f"{english} {german}"), (2, f"{german}")], "idx long, filtered_text string")
    found = S.to_sentences(df, labels=W.CR_LABELS).select("idx", "sents").collect()
    assert [(r.idx, r.sents) for r in found] == [(1, english)]


def test_lines_are_not_normalised(spark):
    df = spark.createDataFrame([(1, "the  first line here\nthe second line there")], "idx long, Related_sents string")
    out = S.cut_filings(df, "Related_sents", lines=True).orderBy("pos")
    assert [r.sents for r in out.collect()] == ["the  first line here", "the second line there"]


def test_unknown_words_and_gazetteer(spark):
    df = spark.createDataFrame([(1, 0, "the zorb met New Amsterdam Traders in the fog")], "idx long, pos int, sents string")
    voc = spark.createDataFrame([(w,) for w in "the met in fog New Amsterdam Traders".split()], "word string")
    ann = S.with_annotation(E.with_unknown_words(df, voc))
    assert ann.select(K.entity_tokens(F.col("ann"), oov=F.col("oov"))).first()[0] == [
        "the", "OOV", "met", "New", "Amsterdam", "Traders", "in", "the", "fog",
    ]
    long = spark.createDataFrame([(1, 0, "we met Ash, Birch and First Trust of North Elm River Mills today")], "idx long, pos int, sents string")
    table = spark.createDataFrame([("ORG", "Ash, Birch"), ("ORG", "First Trust of North Elm River Mills")], "label string, text string")
    taken = lexicon.with_gazetteer(S.with_annotation(long), table).first().ann
    assert len([t for t in taken if t.ent == "ORG"]) == 2
    names = spark.createDataFrame([("LOC", "New Amsterdam"), ("ORG", "New Amsterdam Traders")], "label string, text string")
    marked = lexicon.with_gazetteer(ann, names)
    assert [(t.ent, t.text) for t in marked.first().ann if t.ent] == [("ORG", "New Amsterdam Traders")]
    assert [t.text for t in marked.first().ann][:3] == ["the", "zorb", "met"]


def spans_by_hand(sentences, names):
    """Every place of every name, by comparing token lists."""
    return {
        (idx, pos, i, len(name), label, " ".join(name))
        for idx, pos, words in sentences
        for label, name in names
        for i in range(len(words or []))
        if name and words[i : i + len(name)] == name
    }


@pytest.mark.parametrize("bound", [lexicon.BROADCAST_BYTES, -1], ids=["sent", "shuffled"])
def test_name_spans_against_lists(spark, monkeypatch, bound):
    monkeypatch.setattr(lexicon, "BROADCAST_BYTES", bound)
    draw = random.Random(7)
    words = ["the", "the", "the", "bank", "of", "north", "x"]
    text = [[draw.choice(words) for _ in range(draw.randint(0, 30))] for _ in range(200)]
    sentences = [(i, 0, w) for i, w in enumerate(text)] + [(500, 0, None), (501, 0, ["the", None, "bank", "the", "bank"])]
    names = [(draw.choice("AB"), [draw.choice(words) for _ in range(draw.randint(1, 5))]) for _ in range(40)]
    names += [("A", text[3][:25]), ("B", text[3][:25]), ("A", ["absent", "name"])]
    listed = [(label, "  " + " ".join(name)) for label, name in names] + [("A", ""), ("A", None), (None, "the")]
    df = spark.createDataFrame(sentences, "idx long, pos int, words array<string>")
    table = spark.createDataFrame(listed, "label string, text string")
    found = [tuple(r) for r in lexicon.name_spans(df, F.col("words"), table).collect()]
    assert len(found) == len(set(found))
    assert set(found) == spans_by_hand(sentences, names)
    assert lexicon.name_spans(df, F.col("words"), table.limit(0)).count() == 0
    assert lexicon.name_spans(df.limit(0), F.col("words"), table).count() == 0


@pytest.mark.parametrize("starts", [lexicon.FIRST_TOKENS, 0])
def test_many_names_of_few_first_tokens_shuffle_no_sentence(spark, monkeypatch, starts):
    monkeypatch.setattr(lexicon, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(lexicon, "FIRST_TOKENS", starts)
    kept = []
    monkeypatch.setattr(lexicon, "cut_lineage", lambda df: kept.append(df.columns) or cut_lineage(df))
    sentences = [(i, 0, ["we", "met", "Customer", "No", str(i), "and", "Customer", "No", "x", None]) for i in range(60)]
    names = [("A", ["Customer", "No", str(i)]) for i in range(50)] + [("B", ["Customer"])]
    table = spark.createDataFrame([(label, " ".join(name)) for label, name in names], "label string, text string")
    df = spark.createDataFrame(sentences, "idx long, pos int, words array<string>")
    found = {tuple(r) for r in lexicon.name_spans(df, F.col("words"), table).collect()}
    assert found == spans_by_hand(sentences, names)
    assert not [columns for columns in kept if "sentence" in columns]


def test_entity_table(spark):
    df = spark.createDataFrame([(1, 0, "The FDA told Acme Corp. that IBM filed Form 8-K")], "idx long, pos int, sents string")
    table = {(r.label, r.text) for r in E.word_entity_table(S.with_annotation(df)).collect()}
    assert {("GOV", "FDA"), ("FILING", "Form 8-K"), ("is_upper", "IBM"), ("modified_ORG", "Acme Corp.")} <= table


def test_costly_patterns_are_tried_only_where_they_can_match(spark, capsys):
    free = [r for r in default_rules() if r.anchors is None]
    assert [r.sign for r in free] == ["FY", "FY", "-", ":"]
    assert [Rule("X", p).sign for p in (r"i:fy\d{2}", r"[A-Z]\d", r"\d{2} FY\d{1,2}", r"a{0,1}\d")] == [None, None, "FY", None]
    texts = ["the FY21 and FY2021 on 2020-01-02 at 10:30 a.m. in Acme Holdings, Inc. it's", "(NYSE: ABC) won't", "x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "sents string").select(K.annotate("sents").alias("ann"))
    df.explain()
    plan = capsys.readouterr().out
    assert "array_sort(" not in plan
    found = [[(t.i, t.text, t.ent) for t in r.ann if t.ent] for r in df.collect()]
    assert found == [
        [(1, "FY21", "ACCT"), (3, "FY2021", "ACCT"), (5, "2020-01-02", "DATE"), (7, "10:30 a.m.", "TIME"), (10, "Acme Holdings, Inc.", "ORG")],
        [(0, "(NYSE: ABC)", "TICKER")], [], [],
    ]


def test_a_rule_is_searched_where_all_its_words_stand(spark):
    """Rules are found by the hash of one word; the other long words and the case of plain ones must be there too."""
    needs = {r.pattern: r.needs for r in default_rules()}
    assert needs["i:the dddd{?} Act"] == [(["Act"], True)]
    assert needs["Financial Industry Regulatory Authority"][0] == (["Regulatory"], True) and len(needs["Financial Industry Regulatory Authority"]) == 4
    assert needs["i:annual i:report"] == [(["annual"], False), (["report"], False)]
    assert Rule("X", "[^ab] Title").needs == []
    texts = [
        "THE Act and the act of May 5, may 5", "aNNual REPORT at Acme company, at Acme Company of the United\tStates", None, "  ",
        "the Financial Authority met the Financial Industry Regulatory Authority (nasdaq: X, NYSE: Y) \t end",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, sents string").select("id", K.annotate("sents").alias("ann"))
    found = [r.ann and [(t.i, t.text, t.ent) for t in r.ann if t.ent] for r in df.orderBy("id").collect()]
    assert found == [
        [(0, "THE Act", "LAW"), (6, "May 5", "DATE")], [(0, "aNNual REPORT", "FILING"), (7, "Acme Company", "ORG")], None, [],
        [(5, "Financial Industry Regulatory Authority", "GOV"), (9, "(nasdaq: X, NYSE: Y)", "TICKER")],
    ]
    assert [tuple(t) for t in one(spark, "a \t b of  c", lambda c: K.annotate(c, [Rule("E", ".+ of")]))] == [(0, "a b of", "E"), (3, "c", None)]


def test_a_small_lexicon_is_sent_to_the_sentences(spark, monkeypatch):
    """The words of the sentences aren't shuffled, whether or not adaptive execution learns the table's size in time."""
    df = spark.createDataFrame([(1, 0, "a very good plan"), (1, 0, "a very good plan"), (2, 0, None), (3, 1, "not bad")], "idx long, pos int, sents string")
    lex = spark.createDataFrame([("good", 0.5, 0.6), ("bad", -0.5, 0.6), (None, 1.0, 1.0), ("good", 0.1, 0.2)], "word string, polarity double, subjectivity double")
    words = F.split("sents", " ")
    small = lexicon.sentiment_by_join(df, words, lex)
    hits = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [word" in hits
    monkeypatch.setattr(lexicon, "hinted", lambda table: table)
    joined = lexicon.sentiment_by_join(df, words, lex)
    assert "BroadcastHashJoin [word" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)


def test_sentiment_by_join_doesnt_hang_on_the_order_of_rows(spark):
    """A mean was added up as rows came: 0.4 or 0.39999999999999997."""
    lex = [("good", 0.1, 0.2), ("good", 0.5, 0.6), ("good", 0.7, 0.4)]
    df = spark.createDataFrame([(1, 0, "a good plan")], "idx long, pos int, sents string")
    found = set()
    for rows in (lex, lex[::-1], lex[1:] + lex[:1]):
        table = spark.createDataFrame(rows, "word string, polarity double, subjectivity double").coalesce(1)
        found |= {tuple(r) for r in lexicon.sentiment_by_join(df, F.split("sents", " "), table).collect()}
    assert len(found) == 1
