"""Language identification by bit-sliced Bloom filters over byte n-grams.

One filter serves all languages: a slot holds one bit per language, so the bitwise and of an n-gram's
slots names every language that contains it. A text's hits per language, corrected for that
language's rate of false positives, decide.

An n-gram belongs to a language if it makes up ``MIN_SHARE`` of the language's training n-grams of
its length. At most 1 / MIN_SHARE n-grams of each length can, so the filter's size, which grows only
with the number of languages, is bounded whatever the corpus.
"""

from __future__ import annotations

import regex

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tellsift.llm.hashing import mix, sums
from tellsift.llm.packing import slices

ORDERS = (3, 5)
MIN_SHARE = 1e-5
PROBES = 3
SLICE = 1 << 20
MERGE_AT = 1 << 21

_LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PAD = b" " * max(ORDERS)


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all rows, first byte per row, n-grams per row): lower case, words parted by one space."""
    parts, sizes = [], []
    for text in texts.to_pylist():
        body = b" ".join((text or "").lower().encode("utf-8", "replace").translate(_KEEP).split())
        parts += [b" ", body, _PAD]
        sizes.append(len(body) + 1 if body else 0)
    ends = np.cumsum([len(p) for p in parts])[2::3]
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), firsts, np.array(sizes, dtype=np.int64)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    wide = data.astype(np.uint64)
    out = wide[: len(wide) - max(ORDERS) + 1].copy()
    for i in range(1, n):
        out |= wide[i : len(wide) - max(ORDERS) + 1 + i] << np.uint64(8 * i)
    return out | np.uint64(n << 40)


def _row_places(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) + np.repeat(firsts - (np.cumsum(sizes) - sizes), sizes)


def _reduced(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def gram_counts(df: DataFrame, languages: list[str], text: str, lang: str) -> DataFrame:
    """(language number, n-gram, count), added up within each task first."""
    number = {name: i for i, name in enumerate(languages)}

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in batches:
            for first, texts in slices(batch.column(0), SLICE):
                codes = np.array([number[x] for x in batch.column(1).slice(first, len(texts)).to_pylist()], dtype=np.uint64)
                data, firsts, sizes = _prepared(texts)
                if not sizes.sum():
                    continue
                places, of = _row_places(firsts, sizes), np.repeat(codes << np.uint64(44), sizes)
                for n in ORDERS:
                    key, count = np.unique(_grams(data, n)[places] | of, return_counts=True)
                    keys.append(key)
                    counts.append(count)
                    held += len(key)
                if held > MERGE_AT:
                    key, count = _reduced(keys, counts)
                    keys, counts, held = [key], [count], 0
        if keys:
            key, count = _reduced(keys, counts)
            for at in range(0, len(key), 100_000):
                part = key[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part >> np.uint64(44)).astype(np.int32)), pa.array((part & np.uint64((1 << 44) - 1)).astype(np.int64)), pa.array(count[at : at + 100_000].astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    partial = df.select(text, lang).mapInArrow(run, "lang int, gram long, n long")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """The bit-sliced filter: one plane of bytes for every eight languages."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, probes: int = PROBES):
        self.languages, self.probes = languages, probes
        entries = max(1, len(np.unique(gram)))
        self.slots = 1 << max(10, int(entries * 10 - 1).bit_length())
        self.planes = [np.zeros(self.slots, dtype=np.uint8) for _ in range(-(-len(languages) // 8))]
        for place in self.places(gram.astype(np.uint64)):
            for p, plane in enumerate(self.planes):
                mine = (lang >> 3) == p
                np.bitwise_or.at(plane, place[mine], (1 << (lang[mine] & 7)).astype(np.uint8))
        self.false_rate = np.array(
            [((self.planes[i >> 3] >> (i & 7)) & 1).mean() ** probes for i in range(len(languages))]
        )

    def places(self, gram: np.ndarray):
        h = mix(gram)
        for j in range(self.probes):
            yield ((h >> np.uint64(20 * j)) & np.uint64(self.slots - 1)).astype(np.int64) if self.slots <= 1 << 20 else (
                mix(h + np.uint64(j)) & np.uint64(self.slots - 1)
            ).astype(np.int64)

    def hits(self, data: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Corrected number of n-grams that each language contains, per row."""
        found, places = np.zeros((len(sizes), len(self.languages))), _row_places(firsts, sizes)
        for n in ORDERS:
            slots = list(self.places(_grams(data, n)[places]))
            for p, plane in enumerate(self.planes):
                mask = plane[slots[0]]
                for s in slots[1:]:
                    mask &= plane[s]
                for i in range(8 * p, min(8 * p + 8, len(self.languages))):
                    found[:, i] += sums((mask >> (i & 7)) & 1, sizes)
        total = (sizes * len(ORDERS))[:, None]
        return np.maximum(0, (found - total * self.false_rate) / np.maximum(1e-9, 1 - self.false_rate))


def train(df: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> LanguageFilter | None:
    """Learn from all rows with a language; None if there is none. Rows with null text add nothing."""
    labelled = df.where(F.col(lang).isNotNull())
    languages = [r[0] for r in labelled.groupBy(lang).count().orderBy(F.desc("count"), lang).collect()]
    if not languages:
        return None
    counts = gram_counts(labelled, languages, text, lang)
    counts = counts.withColumn("order", F.shiftright("gram", 40))
    totals = counts.groupBy("lang", "order").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), ["lang", "order"]).where(F.col("n") >= F.col("total") * min_share)
    table = kept.select("lang", "gram").toPandas()
    return LanguageFilter(languages, table["lang"].to_numpy(np.int64), table["gram"].to_numpy(np.int64))


def predict(df: DataFrame, model: LanguageFilter | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add lang_pred and score (the winner's share of all corrected hits) to the columns ``keep``.

    Null text, or text without a letter: ``und``, score 0; so for every text if nothing was learned.
    A text of which no language knows an n-gram gets the most frequent language, score 0. Ties go to
    the more frequent language.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string", "score double"])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for first, texts in slices(batch.column(len(keep)), SLICE):
                rows = [x is not None and bool(_LETTER.search(x)) for x in texts.to_pylist()]
                langs, scores = ["und"] * len(rows), np.zeros(len(rows))
                if model is not None:
                    data, firsts, sizes = _prepared(texts)
                    hits = model.hits(data, firsts, sizes)
                    best, total = hits.argmax(axis=1), hits.sum(axis=1)
                    scores = np.where(rows, hits.max(axis=1) / np.maximum(total, 1e-9), 0.0)
                    langs = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), rows)]
                columns = [batch.column(i).slice(first, len(rows)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    return df.select(*keep, text).mapInArrow(run, schema)
