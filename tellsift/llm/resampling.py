"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Text is cut into runs of letters and digits and runs of other signs. Single tokens and pairs are hashed to
``BUCKETS``; a bucket's share in good texts against its share in all texts gives a log ratio, and a
row's log weight is the sum over its n-grams. Adding seeded Gumbel noise to the log weights and taking
the k largest draws k rows without replacement, in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tellsift.llm.common import cut_lineage, whole_row
from tellsift.llm.hashing import mix, sums, word_groups

BUCKETS = 1 << 15
SEED = 2021
#: Labelled target rows that the target model is fitted on, at most about.
TARGET_KEYS = 200_000


def gram_groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-grams per row, their buckets): every token, then every pair of tokens of a row."""
    for first, counts, words in word_groups(texts, classes=True):
        pairs = mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) else words
        pairs = np.append(pairs, np.uint64(0)).astype(np.uint64) if len(words) else words
        ends = np.cumsum(counts)
        last = ends[counts > 0] - 1
        inside = np.ones(len(words), dtype=bool)
        inside[last] = False
        of = np.repeat(np.arange(len(counts)), counts)
        rows = np.concatenate([of, of[inside]])
        grams = np.concatenate([words, pairs[inside]]) % np.uint64(BUCKETS)
        order = np.argsort(rows, kind="stable")
        yield first, np.maximum(2 * counts - 1, 0), grams[order].astype(np.int64)


def bucket_counts(df: DataFrame, text: str, target: Column) -> DataFrame:
    """(bucket, good, raw): n-grams of the rows where ``target`` holds, and of all rows."""

    def run(batches):
        raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            wanted = np.array(batch.column(1).to_pylist(), dtype=bool)
            for first, counts, grams in gram_groups(batch.column(0)):
                raw += np.bincount(grams, minlength=BUCKETS)
                mine = np.repeat(wanted[first : first + len(counts)], counts)
                good += np.bincount(grams[mine], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(good[some]), pa.array(raw[some])], ["bucket", "good", "raw"])

    rows = df.select(text, F.coalesce(target, F.lit(False)).alias("_good")).mapInArrow(run, "bucket int, good long, raw long")
    return rows.groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """Log of the smoothed shares' ratio per bucket (at most BUCKETS rows reach the driver). Without a
    target row all ratios are 0."""
    rows = counts.toPandas()
    good, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    good[rows["bucket"]], raw[rows["bucket"]] = rows["good"], rows["raw"]
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + 1) / (good.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def log_weights(df: DataFrame, ratios: np.ndarray, keep: tuple[str, ...], text: str = "text", inside: str | None = None) -> DataFrame:
    """The columns ``keep`` and log_weight; 0 for null, empty and blank texts.

    ``text`` is a column of its own, or a field of the kept struct ``inside``, so that it travels once.
    """
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("log_weight", T.DoubleType())])

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)) if inside is None else pc.struct_field(batch.column(keep.index(inside)), text)
            for first, counts, grams in gram_groups(texts):
                columns = [batch.column(i).slice(first, len(counts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums(ratios[grams], counts))], [*keep, "log_weight"])

    return df.select(*keep, *([] if inside else [text])).mapInArrow(run, schema)


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Seeded Gumbel noise of a key, from the first 48 bits of an md5."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 12), 16, 10)
    return -F.log(-F.log((drawn.cast("double") + 0.5) / float(1 << 48)))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048) -> float | None:
    """The k-th largest value of ``column``, exactly: counts per bin, then again inside the bin that holds it."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or n == 0:
        return None
    if k >= n:
        return lo
    rows = df.where(F.col(column).isNotNull())
    while True:
        width = (hi - lo) / bins
        if width == 0 or lo + width == lo:
            return hi
        inside = rows.where(F.col(column).between(lo, hi))
        spot = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
        found = inside.groupBy(spot.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for row in found.orderBy(F.desc("bin")).collect():
            if k <= row["n"]:
                break
            k -= row["n"]
        if row["lo"] == row["hi"]:
            return row["lo"]
        if row["n"] <= 10_000:
            values = [r[0] for r in rows.where(F.col(column).between(row["lo"], row["hi"])).select(column).collect()]
            return sorted(values, reverse=True)[k - 1]
        lo, hi = row["lo"], row["hi"]


def expected_good(good: int, labelled: int, rows: int, z: float = 2.576) -> int:
    """Rows to draw: the upper end of the 99 % Wilson interval of the good share, of all rows. Without labels: all."""
    if not labelled:
        return rows
    p = good / labelled
    upper = (p + z * z / (2 * labelled) + z * np.sqrt(p * (1 - p) / labelled + z * z / (4 * labelled**2))) / (1 + z * z / labelled)
    return int(min(rows, np.ceil(rows * upper)))


def resample(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
    learn: Column | None = None, seed: int = SEED, with_rows: bool = False,
) -> DataFrame:
    """Per row: ``key``, log_weight, gumbel_key and sampled; with ``with_rows`` the whole input row as ``row``.

    Target: rows whose label ``quality`` is 1 (every label of a key counts, 1 wins), only those where ``learn``
    holds; raw: all rows. The target model is fitted on all such keys up to about ``TARGET_KEYS``, beyond that
    on so many drawn by hash, which is what bounds the broadcast; the raw model and the share of good rows
    are counted over everything. As many rows are drawn as are expected to be good; rows that tie with the
    last one drawn are drawn too. Null, empty and blank texts weigh 0. A null key has no label and the
    noise of an empty key. No labels: all rows are drawn. Empty table: no rows.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.max(quality) == 1).alias("_good"))
    marks = cut_lineage(marks)
    learned = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    columns = [F.col(key).alias("_id"), F.col(text).alias("_text"), learned.alias("_learn")]
    known = df.select(*columns, *([whole_row(df).alias("row")] if with_rows else []))
    total = marks.where("_good").count()
    drawn = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(min(1.0, TARGET_KEYS / max(total, 1)) * (1 << 30))
    target = marks.where(F.col("_good") & drawn).select("_key", F.lit(True).alias("_target"))
    flagged = known.join(F.broadcast(target), F.col("_id") == F.col("_key"), "left")
    ratios = log_ratios(bucket_counts(flagged, "_text", F.col("_target") & F.col("_learn")))
    noisy = F.col("log_weight") + gumbel(F.col("_id"), seed)
    narrow = cut_lineage(log_weights(known, ratios, ("_id", "_learn"), "_text").withColumn("gumbel_key", noisy))
    labelled, good = narrow.where("_learn").join(marks, F.col("_id") == F.col("_key")).agg(F.count("*"), F.count_if("_good")).first()
    least = kth_largest(narrow, "gumbel_key", expected_good(good, labelled, narrow.count()))
    weighed = log_weights(known, ratios, ("_id", "row"), text, inside="row").withColumn("gumbel_key", noisy) if with_rows else narrow
    return weighed.select(
        F.col("_id").alias(key), "log_weight", "gumbel_key",
        (F.col("gumbel_key") >= F.lit(least if least is not None else 0.0)).alias("sampled"),
        *(["row"] if with_rows else []),
    )
