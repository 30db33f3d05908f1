"""Scored sentences and their roll-up to filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tellsift.functions.text import let
from tellsift.operators.evaluate import apply_threshold

EVENT_WORDS = [
    "breach", "breached", "unauthorized", "access", "accessed", "hacker", "hackers", "malicious",
    "malware", "theft", "stolen", "intrusion", "incident", "compromised", "disclosed", "attack",
]


def keyword_score(words: Column, keywords: list[str] = EVENT_WORDS) -> Column:
    """Share of the words that are keywords; a score that needs no model."""
    return let(
        words,
        lambda ws: F.coalesce(
            F.try_divide(
                F.size(F.filter(ws, lambda w: w.isin(keywords))).cast("double"),
                F.size(ws).cast("double"),
            ),
            F.lit(0.0),
        ),
    )


def roll_up(positive: DataFrame, name: str, key: str = "idx") -> DataFrame:
    """Positive sentences of each filing: joined in order, counted, mean score.

    A group is the positive part of one filing, so it is no larger than its text.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "sents"))), lambda s: s["sents"])
    return positive.groupBy(key).agg(
        F.array_join(ordered, "\n").alias(f"{name}_sents"),
        F.count("*").alias(f"{name}_sents_num"),
        F.avg("proba").alias(f"{name}_proba"),
    )


def filing_result(
    filings: DataFrame,
    scored: DataFrame,
    name: str,
    threshold,
    output: str = "whole",
    key: str = "idx",
    inclusive: bool = False,
) -> DataFrame:
    """Result of scoring: ``whole`` filings with their hits, ``pos_sents`` or ``all_sents``."""
    predicted = apply_threshold(scored, threshold, inclusive=inclusive)
    if output == "all_sents":
        return predicted
    positive = predicted.where("pred = 1")
    if output == "pos_sents":
        return positive
    if output != "whole":
        raise ValueError(f"unknown output {output!r}")
    return filings.join(roll_up(positive, name, key), key)


def roll_up_arrays(
    filings: DataFrame, sentences: Column, score, name: str, threshold: float
) -> DataFrame:
    """``filing_result`` for a score that is an expression of the sentence: no shuffle at all.

    ``sentences`` is the array of sentences of a filing; ``score`` maps a sentence to its score.
    """
    scored = F.transform(sentences, lambda s: F.struct(s.alias("s"), score(s).alias("p")))

    def result(hits: Column) -> Column:
        total = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h["p"])
        return F.filter(
            F.array(
                F.struct(
                    F.array_join(F.transform(hits, lambda h: h["s"]), "\n").alias(f"{name}_sents"),
                    F.size(hits).cast("bigint").alias(f"{name}_sents_num"),
                    F.try_divide(total, F.size(hits)).alias(f"{name}_proba"),
                )
            ),
            lambda _: F.size(hits) > 0,
        )

    found = let(F.filter(scored, lambda x: x["p"] > threshold), result)
    return filings.select("*", F.inline(found))
