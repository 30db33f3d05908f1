"""Word and n-gram frequencies and their comparison between label groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tellsift.functions import tokens as K
from tellsift.operators.common import computed
from tellsift.operators.ranks import first_per_group


def top_words(sentences: DataFrame, words: Column, n: int = 100) -> DataFrame:
    """The ``n`` words with most occurrences per 1000 sentences; ties by word.

    All sentences count, also those without any word.
    """
    counts = _marked(sentences, words).groupBy("word", "_end").agg(F.count("*").alias("c"))
    top = counts.orderBy(F.desc("_end"), F.desc("c"), "word").limit(n + 1)
    whole = F.max(F.when(F.col("_end"), F.col("c"))).over(Window.partitionBy(F.lit(0)))
    return top.withColumn("_total", whole).where(~F.col("_end")).select("word", (F.col("c") / F.col("_total") * 1000).alias("freq"))


def _marked(sentences: DataFrame, words: Column, **flags: Column) -> DataFrame:
    """``(word, _end)``: the words of every sentence and one row that stands for the sentence itself, with its ``flags``.

    So one pass over the text counts words and sentences.
    """
    held = computed(sentences, _w=F.coalesce(words, F.array().cast("array<string>")), **flags)
    place = F.posexplode(F.concat("_w", F.array(F.lit(None).cast("string")))).alias("_i", "word")
    found = held.select(F.size("_w").alias("_n"), *flags, place)
    return found.select("word", (F.col("_i") == F.col("_n")).alias("_end"), *flags)


def compare_top_words(
    sentences: DataFrame, words: Column, keys: list[str], n: int = 100
) -> DataFrame:
    """Top words of all sentences and of the positive and negative ones of every label, side by side.

    One pass counts every group at once. A word shows a value only in the groups whose top ``n``
    it belongs to.
    """
    groups = {"avg_all": F.lit(True)}
    for key in keys:
        groups[f"{key}_pos"] = F.col(key) == 1
        groups[f"{key}_neg"] = F.col(key) == 0
    counts = (
        _marked(sentences, words, **groups)
        .groupBy(F.col("word").alias("words"), "_end")
        .agg(*[F.count_if(g).alias(g) for g in groups])
    )
    long = counts.unpivot(["words", "_end"], list(groups), "grp", "c").where("c > 0")
    # a group's sentences, a null, come first, then its words
    order = long.withColumn("_neg", F.when(~F.col("_end"), -F.col("c")))
    first = first_per_group(order, ["grp"], ["_neg", "words"], n + 1)
    whole = F.max(F.when(F.col("_end"), F.col("c"))).over(Window.partitionBy("grp"))
    return (
        first.withColumn("total", whole)
        .where(~F.col("_end"))
        .groupBy("words")
        .agg(
            *[
                F.max(F.when(F.col("grp") == g, F.col("c") / F.col("total") * 1000)).alias(g)
                for g in groups
            ]
        )
    )


def gram_array(
    text: Column, low: int = 1, high: int | None = None, lower: bool = True, stop: list[str] | None = None
) -> Column:
    """N-grams of the default words of a text, stop words taken out first."""
    words = K.default_words(text, lower)
    if stop:
        words = K.remove_words(words, stop)
    return K.ngrams(words, low, high)


def token_grams(
    tokens: Column, low: int = 1, high: int | None = None, lower: bool = False, stop: list[str] | None = None
) -> Column:
    """N-grams of a token string."""
    words = F.filter(F.split(F.lower(tokens) if lower else tokens, " "), lambda w: w != "")
    if stop:
        words = K.remove_words(words, stop)
    return K.ngrams(words, low, high)
