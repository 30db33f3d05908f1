"""Filings to sentences with tokens and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tellsift.functions import features as X, text as T, tokens as K
from tellsift.functions.rules import Rule
from tellsift.operators.common import computed


def cut_filings(
    filings: DataFrame,
    text_col: str,
    lines: bool = False,
    distinct: bool = False,
    keep_text: bool = False,
) -> DataFrame:
    """One row per sentence: the filing's columns with ``pos`` and ``sents``.

    ``lines`` takes text that is already cut, one sentence per line. ``distinct`` drops repeated
    sentences of a filing, the first stays; this needs no shuffle since a filing is one row.
    """
    text = F.col(text_col)
    sents = T.split_lines(text) if lines else T.segment(T.normalise(text))
    if distinct:
        sents = F.array_distinct(sents)
    kept = [c for c in filings.columns if keep_text or c != text_col]
    return filings.where(text.isNotNull()).select(*kept, F.posexplode(sents).alias("pos", "sents"))


def only_language(filings: DataFrame, text_col: str, lang: str = "en") -> DataFrame:
    """Filings whose function words are mostly those of ``lang``."""
    return filings.where(T.language(F.col(text_col)) == lang)


def with_annotation(sentences: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Add the annotated token array ``ann``."""
    return computed(sentences, ann=K.annotate("sents", rules))


def with_tokens_and_pos(
    annotated: DataFrame, labels: list[str] | None = None, tokenizer=None
) -> DataFrame:
    """Add ``tokens`` and the part-of-speech columns from ``ann``; sentences without words go.

    ``tokenizer`` maps the annotated token array to an array of strings.
    """
    tokenizer = tokenizer or (lambda ann: K.entity_tokens(ann, labels))
    staged = computed(
        annotated,
        tokens=F.array_join(tokenizer(F.col("ann")), " "),
        _pos=X.pos_features(F.col("ann")),
    )
    kept = [c for c in annotated.columns if c != "ann"]
    return staged.select(*kept, "tokens", *[f"_pos.{c}" for c in X.POS_COLUMNS]).dropna(
        subset=["tokens", *X.POS_COLUMNS]
    )


def to_sentences(
    filings: DataFrame,
    text_col: str = "filtered_text",
    labels: list[str] | None = None,
    tokenizer=None,
    lines: bool = False,
    lang: str | None = "en",
    rules: list[Rule] | None = None,
) -> DataFrame:
    """Valid, distinct sentences of every filing with tokens and part-of-speech features.

    With ``lang`` each sentence is tested for itself, so that a filing in several languages keeps the
    sentences of this one; a sentence without any known function word follows its filing.
    """
    if lang is not None:
        filings = computed(filings, _lang=T.language(F.col(text_col)))
    cut = cut_filings(filings, text_col, lines=lines, distinct=True)
    if lang is not None:
        cut = cut.where(F.coalesce(T.language(F.col("sents")), F.col("_lang")) == lang).drop("_lang")
    annotated = with_annotation(cut, rules).where(K.valid_sentence(F.col("ann")))
    return with_tokens_and_pos(annotated, labels, tokenizer)


def add_tokens_pos(
    sentences: DataFrame,
    labels: list[str] | None = None,
    tokenizer=None,
    sent_col: str = "sents",
    lang: str | None = "en",
    rules: list[Rule] | None = None,
) -> DataFrame:
    """Tokens and part-of-speech features for a ready table of sentences; other languages go."""
    if lang is not None:
        sentences = only_language(sentences, sent_col, lang)
    annotated = computed(sentences, ann=K.annotate(sent_col, rules))
    return with_tokens_and_pos(annotated, labels, tokenizer)
