"""Seeded sampling per group, splits, folds and rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tellsift.operators.ranks import exact_rank, first_per_group, order_key
from tellsift.functions.words import LABEL_COLUMNS

SEED = 2021


def top_sample(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """The first ``n`` rows in seeded order."""
    return df.orderBy(order_key(seed, key), key).limit(n)


def firm_winners(
    filings: DataFrame,
    ciks: DataFrame | None = None,
    text_col: str = "filtered_text",
    key: str = "idx",
    within: list[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Firm (and file, with ``within``) and key of one random filing with text for each; no texts."""
    groups = [*(within or []), "cik"]
    usable = filings.withColumn("cik", F.col("cik").cast("string")).where(
        F.col(text_col).isNotNull() & F.col("cik").isNotNull()
    )
    if ciks is not None:
        wanted = ciks.select(F.col("cik").cast("string").alias("cik"))
        usable = usable.join(wanted, "cik", "left_semi")
    winners = usable.groupBy(*groups).agg(
        F.min(F.struct(order_key(seed, key).alias("h"), F.col(key).alias("k"))).alias("w")
    )
    return winners.select(*groups, F.col("w.k").alias(key))


def _with_rows(filings: DataFrame, winners: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """The filings that won. A key may come back in another file, so all of ``names`` must meet."""
    whole = filings.withColumn("cik", F.col("cik").cast("string")).where(F.col(text_col).isNotNull())
    return whole.join(winners.select(*names), names, "left_semi")


def one_per_firm(
    filings: DataFrame,
    ciks: DataFrame | None = None,
    text_col: str = "filtered_text",
    key: str = "idx",
    within: list[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """One random filing with text per firm (and per file, with ``within``)."""
    winners = firm_winners(filings, ciks, text_col, key, within, seed)
    return _with_rows(filings, winners, text_col, [*(within or []), "cik", key])


def sample_firms(
    filings: DataFrame,
    ciks: DataFrame | None = None,
    nmax: int | None = 160,
    text_col: str = "filtered_text",
    key: str = "idx",
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """One filing for each of at most ``nmax`` firms, and a row with firms found and the share kept.

    The winners are cut to ``nmax`` before the texts are joined to them.
    """
    winners = firm_winners(filings, ciks, text_col, key, seed=seed)
    chosen = top_sample(winners, nmax, key, seed + 1) if nmax is not None else winners
    sample = _with_rows(filings, chosen, text_col, ["cik", key]).select(key, "cik", text_col)
    kept = F.least(F.col("unique_firms"), F.lit(nmax)) if nmax is not None else F.col("unique_firms")
    stats = winners.agg(F.count("*").alias("unique_firms")).select(
        "unique_firms", F.coalesce(F.try_divide(kept, F.col("unique_firms")), F.lit(0.0)).alias("select_per")
    )
    return sample, stats


def sample_files(
    filings: DataFrame,
    ciks: DataFrame | None = None,
    nmax: int | None = 160,
    text_col: str = "filtered_text",
    key: str = "idx",
    file_col: str = "file",
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """``sample_firms`` for every input file in one plan, with firms and share per file."""
    winners = firm_winners(filings, ciks, text_col, key, [file_col], seed)
    chosen = winners
    if nmax is not None:
        keyed = winners.withColumn("_h", order_key(seed + 1, key))
        chosen = first_per_group(keyed, [file_col], ["_h", key], nmax).drop("_h")
    sample = _with_rows(filings, chosen, text_col, [file_col, "cik", key])
    kept = F.least(F.col("unique_firms"), F.lit(nmax)) if nmax is not None else F.col("unique_firms")
    stats = (
        winners.groupBy(file_col)
        .agg(F.count("*").alias("unique_firms"))
        .withColumn("select_per", kept / F.col("unique_firms"))
    )
    return sample.select(key, "cik", file_col, text_col), stats


def repeated_firms(sample: DataFrame) -> DataFrame:
    """Number of rows whose firm occurs before in the sample."""
    return sample.agg((F.count("*") - F.countDistinct("cik")).alias("duplicate_firms"))


def sentences_per_firm(
    sentences: DataFrame, nsents: int | None = 2, keys: tuple[str, ...] = ("idx", "pos"), seed: int = 42
) -> DataFrame:
    """At most ``nsents`` random sentences per firm, sorted by firm, with blank label columns."""
    if nsents is not None:
        keyed = sentences.withColumn("_h", order_key(seed, *keys))
        sentences = first_per_group(keyed, ["cik"], ["_h", *keys], nsents).drop("_h")
    return blank_labels(sentences).orderBy("cik", *keys)


def blank_labels(df: DataFrame, columns: list[str] = LABEL_COLUMNS) -> DataFrame:
    """Empty columns for annotators."""
    return df.withColumns({c: F.lit("") for c in columns})


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows per equal-width bin; bin 0 and ``bins + 1`` hold what lies outside."""
    bin_no = F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins))
    return df.groupBy(bin_no.cast("int").alias("bin")).agg(F.count("*").alias("rows"))


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``part``: the same share of every class goes to ``test``; a null label counts as 0."""
    filled = df.withColumn(label, F.coalesce(F.col(label), F.lit(0)))
    ranked = exact_rank(filled.withColumn("_h", order_key(seed, key)), [label], "_h", [key])
    test = F.col("rank") <= F.round(F.col("group_rows") * test_size)
    return ranked.withColumn("part", F.when(test, "test").otherwise("train")).drop(
        "_h", "rank", "group_rows"
    )


def stratified_folds(
    df: DataFrame, label: str, key: str, folds: int = 3, seed: int = SEED
) -> DataFrame:
    """Add ``fold``: every class is dealt out evenly."""
    ranked = exact_rank(df.withColumn("_h", order_key(seed, key)), [label], "_h", [key])
    fold = F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int")
    return ranked.withColumn("fold", fold).drop("_h", "rank", "group_rows")


def _class_sizes(df: DataFrame, label: str, pick) -> Column:
    return df.groupBy(label).count().agg(pick("count")).scalar()


def undersample(df: DataFrame, label: str, key: str, seed: int = SEED) -> DataFrame:
    """Cut every class to the size of the smallest."""
    ranked = exact_rank(df.withColumn("_h", order_key(seed, key)), [label], "_h", [key])
    least = _class_sizes(df, label, F.min)
    return ranked.where(F.col("rank") <= least).drop("_h", "rank", "group_rows")


def oversample(df: DataFrame, label: str, key: str, seed: int = SEED) -> DataFrame:
    """Repeat rows until every class has the size of the largest; ``copy`` numbers them."""
    ranked = exact_rank(df.withColumn("_h", order_key(seed, key)), [label], "_h", [key])
    most = _class_sizes(df, label, F.max)
    whole = F.floor(most / F.col("group_rows"))
    rest = F.pmod(most, F.col("group_rows"))
    copies = whole + F.when(F.col("rank") <= rest, 1).otherwise(0)
    return ranked.withColumn(
        "copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))
    ).drop("_h", "rank", "group_rows")
