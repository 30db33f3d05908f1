"""Length, part-of-speech and sentiment features of one sentence, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tellsift.functions.text import let
from tellsift.functions.tokens import plain_tokens
from tellsift.functions import words as W

LENGTH_COLUMNS = ["char_count", "avg_word_length", "unique_count", "unique_vs_words"]
POS_COLUMNS = ["token_count", "VBD_perc", "VBN_perc", "MD_perc", "VERB_perc", "NOUN_perc"]
SENTIMENT_COLUMNS = ["polarity", "subjectivity"]
MAX_LEXICON = 10_000


def length_features(text: Column) -> Column:
    """``struct`` of the four length features; words are split on a single blank."""

    def build(words: Column) -> Column:
        n = F.size(words)
        chars = F.length(F.array_join(words, ""))
        unique = F.size(F.array_distinct(words))
        return F.struct(
            F.log1p(chars.cast("double")).alias("char_count"),
            (chars / n).alias("avg_word_length"),
            F.log1p(unique.cast("double")).alias("unique_count"),
            (unique / n).alias("unique_vs_words"),
        )

    return let(F.split(text, " "), build)


def pos_tag(words: Column, i: Column) -> Column:
    """Tag of the lower-cased word at ``i`` from closed classes, irregular forms and endings.

    A form in -ed is a participle after a form of be or have, an adverb between them skipped,
    and a past tense elsewhere.
    """
    word = F.get(words, i)
    before = F.get(words, i - 1)
    helper = F.when(before.isin(W.SKIPPED_ADVERBS), F.get(words, i - 2)).otherwise(before)
    led = F.coalesce(helper.isin(W.BE_HAVE), F.lit(False))
    regular = word.endswith("ed") & word.rlike(r"^\p{L}{2,}ed$")
    return (
        F.when(word.isin(W.MODALS), "MD")
        .when(word.isin(W.AUX_PAST), "AUX_PAST")
        .when(word.isin(W.AUX_OTHER), "AUX")
        .when(word.isin(W.ONLY_PARTICIPLES), "VBN")
        .when(led & (regular | word.isin(W.PARTICIPLES)), "VBN")
        .when(regular | word.isin(W.PAST_FORMS), "VBD")
        .when(word.isin(W.BASE_VERBS), "VB")
        .when(word.isin(W.COMMON_NOUNS) | ((F.length(word) > 4) & word.rlike(rf"^\p{{L}}{{2,}}{W.NOUN_ENDINGS}")), "NN")
        .otherwise("X")
    )


def pos_features(tokens: Column) -> Column:
    """``struct`` of the six part-of-speech features of an annotated token array.

    Shares are of the tokens that are no punctuation; without any they are null.
    """
    lowered = F.transform(
        F.filter(tokens, lambda t: t["text"].rlike(r"[\p{L}\d$%€£]")),
        lambda t: F.when(t["ent"].isNull(), F.lower(t["text"])).otherwise(""),
    )

    def build(words: Column) -> Column:
        n = F.size(words)
        tags = F.transform(words, lambda _, i: pos_tag(words, i))

        def counts(tag: Column) -> Column:
            def share(*names: str) -> Column:
                return F.try_divide(
                    F.size(F.filter(tag, lambda t: t.isin(*names))).cast("double"), n.cast("double")
                )

            return F.struct(
                F.log1p(n.cast("double")).alias("token_count"),
                share("VBD", "AUX_PAST").alias("VBD_perc"),
                share("VBN").alias("VBN_perc"),
                share("MD").alias("MD_perc"),
                share("VBD", "VBN", "VB").alias("VERB_perc"),
                share("NN").alias("NOUN_perc"),
            )

        return let(tags, counts)

    return let(lowered, build)


def _lookup(word: Column, groups: list[tuple[float, list[str]]], default: float) -> Column:
    return reduce(
        lambda rest, group: F.when(word.isin(group[1]), F.lit(float(group[0]))).otherwise(rest),
        reversed(groups),
        F.lit(float(default)),
    )


def sentiment_features(
    words: Column,
    lexicon=W.SENTIMENT,
    negations=W.NEGATIONS,
    intensifiers=W.INTENSIFIERS,
) -> Column:
    """``struct<polarity, subjectivity>`` of a lower-cased word array: means over lexicon hits.

    An intensifier multiplies the next hit; a negation before it turns the hit by -0.5. The
    lexicon becomes part of the expression and may hold ``MAX_LEXICON`` words;
    ``operators.lexicon.sentiment_by_join`` takes larger ones.
    """
    known = [w for _, _, group in lexicon for w in group]
    if len(known) > MAX_LEXICON:
        raise ValueError("lexicon too large for an expression; use sentiment_by_join")
    polarity = [(p, g) for p, _, g in lexicon]
    subjectivity = [(s, g) for _, s, g in lexicon]
    boosters = [w for _, group in intensifiers for w in group]

    def values(all_words: Column) -> Column:
        places = F.filter(
            F.transform(all_words, lambda _, i: i), lambda i: F.get(all_words, i).isin(known)
        )

        def value(i: Column) -> Column:
            word, before = F.get(all_words, i), F.get(all_words, i - 1)
            boosted = F.coalesce(before.isin(boosters), F.lit(False))
            far = F.when(boosted, F.get(all_words, i - 2)).otherwise(before)
            negated = F.coalesce(far.isin(negations), F.lit(False))
            score = (
                _lookup(word, polarity, 0.0)
                * F.when(boosted, _lookup(before, intensifiers, 1.0)).otherwise(F.lit(1.0))
                * F.when(negated, F.lit(-0.5)).otherwise(F.lit(1.0))
            )
            return F.struct(
                F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)).alias("p"),
                _lookup(word, subjectivity, 0.0).alias("s"),
            )

        return let(F.transform(places, value), means)

    def mean(hits: Column, field: str) -> Column:
        total = F.aggregate(hits, F.lit(0.0), lambda acc, h: acc + h[field])
        return F.coalesce(F.try_divide(total, F.size(hits)), F.lit(0.0))

    def means(hits: Column) -> Column:
        return F.struct(
            mean(hits, "p").alias("polarity"), mean(hits, "s").alias("subjectivity")
        )

    return let(words, values)


def sentence_sentiment(text: Column, **options) -> Column:
    """Sentiment of a sentence given as text."""
    lowered = F.transform(plain_tokens(text), F.lower)
    return sentiment_features(lowered, **options)


def entity_counts(words: Column, labels: list[str]) -> list[Column]:
    """Count columns over the fixed vocabulary URL, EMAIL, NUM, ITEMNUM and ``labels``."""

    def count(label: str) -> Column:
        return F.size(F.filter(words, lambda w: w == label)).alias(label)

    return [count(label) for label in ["URL", "EMAIL", "NUM", "ITEMNUM", *labels]]
