"""Comparisons of labelled sentences by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tellsift.functions import features as X, tokens as K
from tellsift.operators import evaluate as EV, frequency as FR
from tellsift.operators.common import computed_struct
from tellsift.operators.sentences import with_annotation


def prepare_labelled(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of labelled tables without firm, blanks as 0, repeated rows once."""
    from tellsift.operators.tables import fill_labels, union_by_name

    return fill_labels(union_by_name(*frames).drop("cik"), keys, 0).dropDuplicates()


def compare_entities(sentences: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    words = K.entity_tokens(F.col("ann"), labels)
    counts = F.struct(*X.entity_counts(words, labels))
    return _compare(with_annotation(sentences), keys, counts)


def compare_lengths(sentences: DataFrame, keys: list[str], column: str = "sents") -> DataFrame:
    return _compare(sentences, keys, X.length_features(F.col(column)))


def compare_pos(sentences: DataFrame, keys: list[str]) -> DataFrame:
    return _compare(with_annotation(sentences), keys, X.pos_features(F.col("ann")))


def compare_sentiment(sentences: DataFrame, keys: list[str]) -> DataFrame:
    return _compare(sentences, keys, X.sentence_sentiment(F.col("sents")))


def compare_with(sentences: DataFrame, keys: list[str], feature_func) -> DataFrame:
    """``feature_func`` maps the table to one with more numeric columns, which are compared."""
    more = feature_func(sentences)
    return EV.compare_features(more, keys, [c for c in more.columns if c not in sentences.columns])


def _compare(df: DataFrame, keys: list[str], struct: Column) -> DataFrame:
    base = df.select(*df.columns)
    more = computed_struct(base, struct)
    return EV.compare_features(more, keys, [c for c in more.columns if c not in base.columns])


def compare_grams(sentences: DataFrame, keys: list[str], n: int, labels: list[str], top: int = 100) -> DataFrame:
    """Top n-grams of entity tokens per label group."""
    grams = K.ngrams(K.entity_tokens(F.col("ann"), labels), n)
    return FR.compare_top_words(with_annotation(sentences), grams, keys, top)
