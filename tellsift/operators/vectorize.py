"""Term counts and TF-IDF weights as ``(key, term, weight)`` triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tellsift.operators.common import computed
from tellsift.session import cut_lineage, written


def term_counts(df: DataFrame, key: str, grams: Column) -> DataFrame:
    """Occurrences ``tf`` of every term in every row.

    A row's terms are sorted and counted inside the row, by the places where a new term begins, so nothing
    is shuffled.
    """
    terms = computed(df.select(key, *[c for c in df.columns if c != key]), _terms=F.sort_array(grams)).select(key, "_terms")
    places = F.when(F.size("_terms") > 0, F.sequence(F.lit(0), F.size("_terms") - 1)).otherwise(F.array().cast("array<int>"))
    new = F.filter(places, lambda i: (i == 0) | (F.get("_terms", i) != F.get("_terms", i - 1)))
    runs = computed(terms, _from=new)
    tf = F.transform(
        F.col("_from"),
        lambda at, i: F.struct(
            F.get("_terms", at).alias("term"),
            (F.coalesce(F.get("_from", i + 1), F.size("_terms")) - at).cast("long").alias("tf"),
        ),
    )
    return runs.select(key, F.inline(tf))


def vocabulary(
    counts: DataFrame,
    n_docs: Column | int,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """Terms in at least ``min_df`` rows and at most the share ``max_df`` of them.

    ``max_features`` keeps the terms with most occurrences, ties by term.
    """
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    terms = terms.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs))
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    return terms


def term_ids(terms: DataFrame, tasks: int | None = None) -> DataFrame:
    """Add ``id``, from 0 without gaps in the order of the terms."""
    return numbered(terms, "term", tasks)


def numbered(terms: DataFrame, by: str, tasks: int | None = None) -> DataFrame:
    """Add ``id``, from 0 without gaps in the order of the column ``by``, whose values differ.

    Terms are cut into ranges, numbered inside each and moved up by the terms of the ranges before; only one count per
    range meets in one task.
    """
    cut = (terms.repartitionByRange(tasks, by) if tasks else terms.repartitionByRange(by)).withColumn("_range", F.spark_partition_id())
    cut = written(cut)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(by))
    return cut.withColumn("_at", inside).join(offsets, "_range").select(*terms.columns, (F.col("_before") + F.col("_at") - 1).alias("id"))


def sparse_rows(counts: DataFrame, numbered: DataFrame, key: str) -> DataFrame:
    """``(key, id, tf)`` of the numbered terms; the dictionary is a table and is met by a join."""
    return counts.join(numbered.select("term", "id"), "term").select(key, "id", "tf")


def corpus_tfidf(
    df: DataFrame, key: str, grams: Column, n_docs: Column | int, min_df: int = 1, max_df: float = 1.0, sublinear: bool = False
) -> DataFrame:
    """The weights of all rows against their own vocabulary. Texts are cut and counted once: the counts are written,
    and both the vocabulary and the weights read them."""
    counts = cut_lineage(term_counts(df, key, grams))
    return tfidf(counts, vocabulary(counts, n_docs, min_df, max_df), n_docs, key, sublinear=sublinear)


def tfidf(
    counts: DataFrame,
    terms: DataFrame,
    n_docs: Column | int,
    key: str,
    use_idf: bool = True,
    sublinear: bool = False,
    norm: bool = True,
) -> DataFrame:
    """Weights ``tf * (ln((1 + n) / (1 + df)) + 1)``, each row scaled to length one.

    ``sublinear`` takes ``1 + ln(tf)``. Adaptive execution broadcasts the term table when its
    shuffled size proves small; else it shuffles both sides and splits the partitions of common terms.
    """
    kept = counts.join(terms.select("term", "df"), "term")
    tf = F.col("tf").cast("double")
    weight = F.lit(1.0) + F.log(tf) if sublinear else tf
    if use_idf:
        weight = weight * (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)
    raw = kept.select(key, "term", weight.alias("weight"))
    if not norm:
        return raw
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return raw.select(key, "term", (F.col("weight") / length).alias("weight"))
