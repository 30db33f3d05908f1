"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

A count c is held at level 1 + floor(log_b(c / least)); an n-gram is put into the filter once per level
up to its own, so probing levels in turn until one misses gives the count back. The filter is as large as
the counted n-grams need: every word, every pair met twice and every first word of such a pair is held, at
a fixed share of bits set. Its segments have a fixed size and are rows of a written table. Up to ``BROADCAST_BYTES`` the
filter is broadcast to the workers and probed in place; a larger one is never brought together, and each run of rows asks
every segment once for its distinct words and pairs.

The model: P(w | v) = (c(v, w) + (u(v) + 1) P(w)) / (h(v) + u(v) + 1 + e), with h(v) the sum of the counts
held for pairs that begin with v, u(v) what is missing to c(v), and e the count that false positives are
expected to add over all w. P(w) = (c(w) + 0.5) / Z. Counts are those the filter gives, pairs' rounded down
and h(v) up, so that probabilities don't sum to more than 1. For a v without pairs the model is P(w). The more
words there are, the more bits an entry's first level has, so that e stays under ``FALSE_MASS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tellsift.llm.common import cut_lineage, written
from tellsift.llm.hashing import mix, sums, word_groups

END = np.uint64(0x5851F42D4C957F2D)
BASE = 1.3
#: log2 of a segment's bits.
SEGMENT_BITS = 24
#: Bits set by all entries, as a share of the filter's bits; with those set twice, FULL of the bits are set.
FILL, FULL = 0.28, 0.25
FIRST_PROBES, PROBES = 14, 4
#: The most that false positives are expected to add to the counts of a first word's pairs.
FALSE_MASS = 0.01
#: Distinct sizes of words' counts looked at to choose the head words.
COUNTED = 100_000
#: Tokens whose requests a task holds for a segment at a time, about.
ASKED_TOKENS = 1 << 23
#: The largest filter that is broadcast, and the text of a run that asks a larger one, in bytes.
BROADCAST_BYTES, RUN_BYTES = 1 << 28, 1 << 23
HEAD_WORDS = 1 << 19
BUCKET_PAIRS = 1 << 21
MERGE_AT = 1 << 20
WORD, PAIR, HELD, REST = (np.uint64(x * 0x632BE59BD9B4E019 & (1 << 64) - 1) for x in (1, 2, 3, 4))
LEAST = {"word": 1, "pair": 2, "held": 2, "rest": 1}
_LOW = np.uint64(0xFFFFFFFF)


def token_groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, tokens per row, tokens, the token before each): words, then one end; a row begins after an end."""
    for first, counts, words in word_groups(texts):
        tokens = np.full(len(words) + len(counts), END, dtype=np.uint64)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
        yield first, counts + 1, tokens, np.concatenate([[END], tokens[:-1]]).astype(np.uint64)


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A pair's key: 32 bits of its first word, 32 of both, so that keys of one first word share a half."""
    return ((before & _LOW) << np.uint64(32)) | (mix(before + mix(tokens)) & _LOW)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


class _Sums:
    """Counts of keys within a task, merged now and then; hands out what has grown too large to hold."""

    def __init__(self, most: int = MERGE_AT):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, values: np.ndarray) -> None:
        key, count = np.unique(values, return_counts=True)
        self.keys.append(key)
        self.counts.append(count.astype(np.int64))
        self.held += len(key)

    def take(self, last: bool = False):
        if self.keys and (last or self.held > self.most):
            key, count = _added(self.keys, self.counts)
            if last or len(key) > self.most // 2:
                self.keys, self.counts, self.held = [], [], 0
                return key, count
            self.keys, self.counts, self.held = [key], [count], len(key)
        return None


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows; ``word`` is the token's hash."""

    def rows(found):
        if found is not None:
            key, count = found
            for at in range(0, len(key), 200_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at : at + 200_000].view(np.int64)), pa.array(count[at : at + 200_000])], ["word", "n"]
                )

    def run(batches):
        total = _Sums()
        for batch in batches:
            for _, _, tokens, _ in token_groups(batch.column(0)):
                total.add(tokens)
                yield from rows(total.take())
        yield from rows(total.take(last=True))

    return df.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(df: DataFrame, text: str, tokens: int, least: int) -> DataFrame:
    """(pair, n) for pairs met at least ``least`` times.

    A task adds up its own pairs and sends each bucket one sorted block of keys and counts. The number of
    buckets follows the number of tokens, and a bucket is chosen by the whole key, so none is hot.
    """
    buckets = max(1, -(-tokens // BUCKET_PAIRS))

    def blocks(found):
        if found is not None:
            key, count = found
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key, count = key[order], np.minimum(count[order], 0xFFFFFFFF).astype(np.uint32)
            for b in range(buckets):
                lo, hi = ends[b], ends[b + 1]
                if hi > lo:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([key[lo:hi].tobytes()], pa.binary()), pa.array([count[lo:hi].tobytes()], pa.binary())],
                        ["bucket", "keys", "counts"],
                    )

    def send(batches):
        total = _Sums(4 * MERGE_AT)
        for batch in batches:
            for _, _, words, before in token_groups(batch.column(0)):
                total.add(pair_keys(before, words))
                yield from blocks(total.take())
        yield from blocks(total.take(last=True))

    def gather(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, dtype=np.uint64) for x in table["keys"].to_pylist()]
        counts = [np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in table["counts"].to_pylist()]
        key, count = _added(keys, counts)
        kept = count >= least
        return pa.table({"pair": pa.array(key[kept].view(np.int64)), "n": pa.array(count[kept])})

    sent = df.select(text).mapInArrow(send, "bucket int, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(gather, "pair long, n long")


def level(count, least: int):
    """Column of the level that holds a count."""
    return (F.floor(F.log(BASE, count / F.lit(float(least))) + F.lit(1e-9)) + 1).cast("int")


def count_of(levels: np.ndarray, least: int, place: float) -> np.ndarray:
    """The count that a level stands for: its lower end (place 0), upper end (1) or between; level 0: none."""
    low = np.ceil(least * BASE ** (levels - 1.0) - 1e-6)
    high = np.maximum(low, np.ceil(least * BASE ** (levels + 0.0) - 1e-6) - 1)
    return np.where(levels > 0, low + place * (high - low), 0.0)


def first_probes(words: int) -> int:
    """Bits of an entry's first level that keep the expected false mass of ``words`` words under ``FALSE_MASS``."""
    return max(FIRST_PROBES, ceil(log(max(1, words) * LEAST["pair"] / FALSE_MASS) / -log(FULL)))


def entry_bits(levels, first: int):
    """Bits that an n-gram of so many levels sets; for numbers, arrays and columns."""
    return (levels - 1) * PROBES + first


def bits_set(counts: DataFrame, column: str, least: int, first: int) -> int:
    return counts.agg(F.coalesce(F.sum(entry_bits(level(F.col(column), least), first)), F.lit(0))).first()[0]


def _steps(key: np.ndarray, at_level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an entry's places at a level begin, and how far they lie apart."""
    step = mix(key + np.uint64((at_level * 0xD1342543DE82EF95) & ((1 << 64) - 1)))
    return step, (step >> np.uint64(32)) | np.uint64(1)


def places(key: np.ndarray, at_level: int, probe: int, segment_bits: int) -> np.ndarray:
    step, stride = _steps(key, at_level)
    return (step + np.uint64(probe) * stride) & np.uint64((1 << segment_bits) - 1)


def segment_of(spot: np.ndarray, segments: int) -> np.ndarray:
    """An entry's segment: a pair's by its key, a word's and its pairs' sums by half of the word."""
    return (mix(spot) % np.uint64(segments)).astype(np.int32)


def levels_in(bits: np.ndarray, key: np.ndarray, first: int, segment_bits: int, offset=None, most: int = 200) -> np.ndarray:
    """Levels of keys in a segment's ``bits``; ``offset``: where each key's segment begins, if there are several."""
    found = np.zeros(len(key), dtype=np.uint8)
    live, size = np.arange(len(key)), np.uint64((1 << segment_bits) - 1)
    for at_level in range(1, most):
        rows, (step, stride) = live, _steps(key[live], at_level)
        begin = np.uint64(0) if offset is None else offset[live]
        for _ in range(first if at_level == 1 else PROBES):
            place = begin + (step & size)
            hit = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            rows, stride = rows[hit], stride[hit]
            step, begin = step[hit] + stride, begin if offset is None else begin[hit]
            if not len(rows):
                break
        if not len(rows):
            break
        found[rows] = at_level
        live = rows
    return found


@dataclass
class LogFrequencyFilter:
    """All segments at one place; for looking into small models."""

    bits: np.ndarray
    segments: int
    segment_bits: int
    first: int

    def levels(self, key: np.ndarray, spot: np.ndarray) -> np.ndarray:
        offset = segment_of(spot, self.segments).astype(np.uint64) << np.uint64(self.segment_bits)
        return levels_in(self.bits, key, self.first, self.segment_bits, offset)


@dataclass
class Model:
    table: DataFrame  # written: segment, bits, ones; a segment without entries has no row
    segments: int
    segment_bits: int
    first: int  # bits of an entry's first level
    norm: float
    tokens: int
    distinct: int
    false_mass: float  # count that false positives are expected to add to a first word's pairs
    head_words: np.ndarray  # sorted hashes of the most frequent words, at most HEAD_WORDS
    head_counts: np.ndarray

    @property
    def bytes(self) -> int:
        return self.segments << self.segment_bits >> 3

    @cached_property
    def filter(self) -> LogFrequencyFilter:
        out = np.zeros((self.segments, 1 << self.segment_bits >> 3), dtype=np.uint8)
        for row in self.table.toLocalIterator():
            out[row["segment"]] = np.frombuffer(row["bits"], dtype=np.uint8)
        return LogFrequencyFilter(out.ravel(), self.segments, self.segment_bits, self.first)


def _filled(entries: DataFrame, segments: int, segment_bits: int, first: int) -> DataFrame:
    """The filter of (key, level, spot) rows as a written table, one segment to a row."""

    def fill(table: pa.Table) -> pa.Table:
        key, levels = table["key"].to_numpy().view(np.uint64), table["level"].to_numpy()
        bits = np.zeros(1 << segment_bits, dtype=bool)
        for at_level in range(1, int(levels.max()) + 1):
            key, levels = key[levels >= at_level], levels[levels >= at_level]
            for probe in range(first if at_level == 1 else PROBES):
                bits[places(key, at_level, probe, segment_bits).astype(np.int64)] = True
        part = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({
            "segment": table["segment"].slice(0, 1), "bits": pa.array([part], pa.binary()), "ones": pa.array([int(bits.sum())], pa.int64()),
        })

    def dealt(batches):
        for batch in batches:
            segment = segment_of(batch.column(2).to_numpy().view(np.uint64), segments)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(segment)], ["key", "level", "segment"])

    rows = entries.mapInArrow(dealt, "key long, level int, segment int")
    return written(rows.groupBy("segment").applyInArrow(fill, "segment int, bits binary, ones long"))


def _blocks(words: DataFrame) -> DataFrame:
    """Word counts as blocks of bytes, a few to a task, so that the driver reads few rows."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(i).to_numpy().tobytes()], pa.binary()) for i in (0, 1)], ["words", "counts"]
            )

    return words.select("word", "n").mapInArrow(run, "words binary, counts binary")


def _entry(name: str, tag: np.uint64, count: str, least: str, spot) -> list:
    """An entry's key, the value marked with what it counts, its level and what its segment follows."""
    signed = int(np.array(tag).view(np.int64))
    return [F.col(name).bitwiseXOR(F.lit(signed)).cast("long").alias("key"), level(F.col(count), LEAST[least]).alias("level"), spot.alias("spot")]


def train(df: DataFrame, text: str = "text", filter_bits: int = 0) -> tuple[Model, DataFrame]:
    """Count all words and pairs of ``df`` and build the filter; also returns the table of word counts.

    The filter has as many segments as its entries need, and 2 ** ``filter_bits`` bits at least.
    """
    words = cut_lineage(word_counts(df, text))
    tokens, distinct, candidates = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.count_if(F.col("n") >= 2)).first()
    pairs = cut_lineage(pair_counts(df, text, tokens, LEAST["pair"]))
    half = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    held = pairs.groupBy(F.shiftrightunsigned("pair", 32).alias("half")).agg(F.sum("n").alias("held"))
    totals = words.select(half("word").alias("half"), "n").groupBy("half").agg(F.sum("n").alias("n"))
    firsts = held.join(totals, "half").withColumn("rest", F.greatest(F.col("n") - F.col("held"), F.lit(0)))
    firsts = cut_lineage(firsts)
    rests = firsts.where("rest > 0")
    first, segment_bits = first_probes(candidates), SEGMENT_BITS
    needed = sum(
        bits_set(table, column, LEAST[least], first)
        for table, column, least in ((words, "n", "word"), (pairs, "n", "pair"), (firsts, "held", "held"), (rests, "rest", "rest"))
    )
    segments = max(1, ceil(max(needed / FILL, 1 << filter_bits) / (1 << segment_bits)))
    entries = (
        words.select(*_entry("word", WORD, "n", "word", half("word")))
        .unionAll(pairs.select(*_entry("pair", PAIR, "n", "pair", F.col("pair"))))
        .unionAll(firsts.select(*_entry("half", HELD, "held", "held", F.col("half"))))
        .unionAll(rests.select(*_entry("half", REST, "rest", "rest", F.col("half"))))
    )
    table = _filled(entries, segments, segment_bits, first)
    full = table.agg(F.coalesce(F.sum("ones"), F.lit(0))).first()[0] / (segments << segment_bits)
    by_level = words.groupBy(level(F.col("n"), LEAST["word"]).alias("level")).count().collect()
    norm = 0.5 * (distinct + 1) + sum(
        r["count"] * float(count_of(np.array([r["level"]]), LEAST["word"], 0.5)[0]) for r in by_level
    )
    sizes = sorted(((r["n"], r["count"]) for r in words.groupBy("n").count().orderBy(F.desc("n")).limit(COUNTED).collect()), reverse=True)
    held_words, least_head = 0, (sizes[0][0] + 1 if sizes else 1)
    for n, many in sizes:
        if held_words + many > HEAD_WORDS:
            break
        held_words, least_head = held_words + many, n
    head_words, head_counts = np.zeros(held_words, dtype=np.uint64), np.zeros(held_words, dtype=np.int64)
    at = 0
    for row in written(_blocks(words.where(F.col("n") >= least_head))).toLocalIterator():
        part = np.frombuffer(row["words"], dtype=np.uint64)
        head_words[at : at + len(part)], head_counts[at : at + len(part)] = part, np.frombuffer(row["counts"], dtype=np.int64)
        at += len(part)
    order = np.argsort(head_words)
    model = Model(
        table, segments, segment_bits, first, norm, int(tokens), int(distinct),
        full**first * candidates * LEAST["pair"],
        head_words[order], head_counts[order],
    )
    return model, words.where(F.col("n") < least_head)


def _log10(norm: float, false_mass: float, levels: np.ndarray, pair: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 P of each token: ``levels`` has rows for c, h and u of the distinct words, ``pair`` one for each token."""
    c = count_of(levels[0], LEAST["word"], 0.5)
    held = np.where(c >= 2, count_of(levels[1], LEAST["held"], 1.0), 0.0)
    rest = np.where(held > 0, count_of(levels[2], LEAST["rest"], 0.5), 0.0)
    single = (c + 0.5) / norm
    h, u, p = held[before], rest[before], single[at]
    both = np.where((h > 0) & (c[at] >= 2), count_of(pair, LEAST["pair"], 0.0), 0.0)
    smooth = (np.minimum(both, h) + (u + 1) * p) / (h + u + 1 + false_mass)
    return np.log10(np.where(h > 0, smooth, p))


def model_log10(model: Model, uniques: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """log10 P of each token; ``at`` and ``before`` are places in ``uniques``. Reads the whole filter; ``score`` doesn't."""
    pairs = pair_keys(uniques[before], uniques[at])
    return _log10(model.norm, model.false_mass, *_looked_up(model.filter, uniques, pairs, at, before), at, before)


def _looked_up(held: LogFrequencyFilter, words: np.ndarray, pairs: np.ndarray, at: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of the distinct words (c, h, u) and of each token's pair, 0 where a pair of these words can't be held."""
    halves = words & _LOW
    levels = np.stack([held.levels(keys, halves) for keys in (words ^ WORD, halves ^ HELD, halves ^ REST)])
    pair = np.zeros(len(pairs), dtype=np.uint8)
    asked = np.flatnonzero((levels[1][before] > 0) & (count_of(levels[0], LEAST["word"], 0.5) >= 2)[at])
    pair[asked] = held.levels(pairs[asked] ^ PAIR, pairs[asked])
    return levels, pair


class _Run:
    """Consecutive rows: their tokens, and the distinct words and pairs in order of their segments."""

    def __init__(self, groups: list, segments: int, with_pairs: bool = True):
        self.counts = np.concatenate([g[1] for g in groups])
        self.tokens = np.concatenate([g[2] for g in groups])
        words, at = np.unique(np.append(self.tokens, END), return_inverse=True)
        self.words, self.at, self.word_ends = self._dealt(words, at, words & _LOW, segments)
        self.at, end = self.at[:-1], self.at[-1]
        self.before = np.concatenate([[end], self.at[:-1]])
        pairs = pair_keys(self.words[self.before], self.tokens)
        if not with_pairs:
            self.pairs = pairs  # of each token
            return
        pairs, of = np.unique(pairs, return_inverse=True)
        self.pairs, self.pair_at, self.pair_ends = self._dealt(pairs, of, pairs, segments)

    @staticmethod
    def _dealt(keys, at, spots, segments):
        segment = segment_of(spots, segments)
        order = np.argsort(segment, kind="stable")
        place = np.empty(len(keys), dtype=np.int64)
        place[order] = np.arange(len(keys))
        return keys[order], place[at], np.searchsorted(segment[order], np.arange(segments + 1))


def _runs(chunks: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(chunks[1:] != chunks[:-1]) + 1, [len(chunks)]])
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist()) if len(chunks) else ()


def _chunked(df: DataFrame, keep: tuple[str, ...], text: str) -> DataFrame:
    """Written rows (_chunk, _place, _tokens, keep, text); a chunk has about ``RUN_BYTES`` of text of one task."""
    kinds = dict(df.dtypes)
    schema = ", ".join(["_chunk long, _place long, _tokens long", *[f"`{c}` {kinds[c]}" for c in keep], "_text string"])

    def run(batches):
        chunk = place = TaskContext.get().partitionId() << 33
        held = 0
        for batch in batches:
            for first, counts, _, _ in token_groups(batch.column(len(keep))):
                rows = len(counts)
                held += pc.sum(pc.binary_length(batch.column(len(keep)).slice(first, rows))).as_py() or 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(rows, chunk, dtype=np.int64)), pa.array(np.arange(place, place + rows, dtype=np.int64)),
                        pa.array(counts.astype(np.int64)), *[c.slice(first, rows) for c in batch.columns],
                    ],
                    ["_chunk", "_place", "_tokens", *keep, "_text"],
                )
                chunk, held, place = (chunk + 1, 0, place + rows) if held >= RUN_BYTES else (chunk, held, place + rows)

    return written(df.select(*keep, text).mapInArrow(run, schema))


def _answers(rows: DataFrame, model: Model) -> DataFrame:
    """(_chunk, _first, segment, words, pairs): levels of the run's distinct words (c, h, u) and pairs in a segment."""
    segments, segment_bits, first = model.segments, model.segment_bits, model.first
    tokens = rows.agg(F.coalesce(F.sum("_tokens"), F.lit(0))).first()[0]
    parts = max(1, -(-tokens // (segments * ASKED_TOKENS)))

    def ask(batches):
        for batch in batches:
            chunks, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi in _runs(chunks):
                run = _Run(list(token_groups(batch.column(2).slice(lo, hi - lo))), segments)
                w, p = run.word_ends, run.pair_ends
                asked = [s for s in range(segments) if w[s + 1] > w[s] or p[s + 1] > p[s]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(asked), chunks[lo])), pa.array(np.full(len(asked), at[lo])), pa.array(asked, pa.int32()),
                        pa.array(np.full(len(asked), int(chunks[lo]) % parts, dtype=np.int32)),
                        pa.array([run.words[w[s] : w[s + 1]].tobytes() for s in asked], pa.binary()),
                        pa.array([run.pairs[p[s] : p[s + 1]].tobytes() for s in asked], pa.binary()),
                    ],
                    ["_chunk", "_first", "segment", "_part", "words", "pairs"],
                )

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        bits = np.frombuffer(held["bits"][0].as_py(), dtype=np.uint8) if held.num_rows else np.zeros(1 << segment_bits >> 3, dtype=np.uint8)
        out = ([], [])
        for batch in asked.select(["words", "pairs"]).to_batches(max_chunksize=256):
            for name, into in (("words", out[0]), ("pairs", out[1])):
                given = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(name).to_pylist()]
                keys, ends = np.concatenate(given), np.cumsum([len(x) for x in given])[:-1]
                sought = (keys ^ PAIR,) if name == "pairs" else (keys ^ WORD, (keys & _LOW) ^ HELD, (keys & _LOW) ^ REST)
                found = np.stack([levels_in(bits, k, first, segment_bits) for k in sought])
                into += [part.tobytes() for part in np.split(found, ends, axis=1)]
        return pa.table({
            "_chunk": asked["_chunk"], "_first": asked["_first"], "segment": asked["segment"],
            "words": pa.array(out[0], pa.binary()), "pairs": pa.array(out[1], pa.binary()),
        })

    asked = rows.select("_chunk", "_place", "_text").mapInArrow(ask, "_chunk long, _first long, segment int, _part int, words binary, pairs binary")
    held = model.table.select("segment", "bits").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["segment", "_part"]

    def met(one: pa.Table, other: pa.Table) -> pa.Table:
        if one.num_rows:
            return answer(one, other)
        return pa.table({n: pa.array([], t) for n, t in (("_chunk", pa.int64()), ("_first", pa.int64()), ("segment", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()))})

    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(met, "_chunk long, _first long, segment int, words binary, pairs binary")


def score(df: DataFrame, model: Model, tail: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Per row: the columns ``keep``, n_tokens, n_known, train_tokens, base_score and score.

    A filter of at most ``BROADCAST_BYTES`` is broadcast and probed where the rows are; the segments of a larger one answer
    runs of rows by a join. The scores are the same.
    The base score needs exact counts. The most frequent words' are at hand in each task (at most
    ``HEAD_WORDS``); the other words of a row are joined with the table ``tail`` of the other counts.
    Null or blank text: the end token alone. Rows with equal keys are scored apart.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "n_tokens long, _known long, _base double, score double, _tail array<long>"])
    names = [*keep, "n_tokens", "_known", "_base", "score", "_tail"]
    norm_, false_mass, segments = model.norm, model.false_mass, model.segments
    shared = df.sparkSession.sparkContext.broadcast((model.head_words, model.head_counts))

    def scores(run: _Run, levels: np.ndarray, pair: np.ndarray) -> list:
        head_words, head_counts = shared.value
        place = np.minimum(np.searchsorted(head_words, run.words), max(0, len(head_words) - 1))
        known = head_words[place] == run.words if len(head_words) else np.zeros(len(run.words), bool)
        exact = np.where(known, head_counts[place], 0) if len(head_words) else np.zeros(len(run.words))
        logs = np.where(known, np.log10(exact + 0.5), 0.0)
        rare = ~known[run.at]
        offsets = np.concatenate([[0], np.cumsum(sums(rare.astype(np.int64), run.counts))]).astype(np.int32)
        return [
            pa.array(run.counts.astype(np.int64)), pa.array(sums(known[run.at].astype(np.int64), run.counts)), pa.array(sums(logs[run.at], run.counts)),
            pa.array(sums(_log10(norm_, false_mass, levels, pair, run.at, run.before), run.counts)),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(run.tokens[rare].view(np.int64))),
        ]

    def given(run: _Run, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        levels, pair = np.zeros((3, len(run.words)), dtype=np.uint8), np.zeros(len(run.pairs), dtype=np.uint8)
        for s, words, pairs in zip(*(answers[c].to_pylist() for c in ("segment", "words", "pairs"))):
            levels[:, run.word_ends[s] : run.word_ends[s + 1]] = np.frombuffer(words, dtype=np.uint8).reshape(3, -1)
            pair[run.pair_ends[s] : run.pair_ends[s + 1]] = np.frombuffer(pairs, dtype=np.uint8)
        return levels, pair

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Rows of a chunk, by the runs in which they asked: a run begins at its first row's place."""
        rows = rows.sort_by("_place")
        begun = answers["_first"].to_numpy()
        firsts = np.unique(begun)
        cuts = [*np.searchsorted(rows["_place"].to_numpy(), firsts).tolist(), rows.num_rows]
        parts = []
        for lo, hi, first in zip(cuts[:-1], cuts[1:], firsts):
            part = rows.slice(lo, hi - lo)
            run = _Run(list(token_groups(part["_text"].combine_chunks())), segments)
            levels, pair = given(run, answers.filter(pa.array(begun == first)))
            found = scores(run, levels, pair[run.pair_at])
            parts.append(pa.table([*[part[c] for c in keep], *found], names=names))
        return pa.concat_tables(parts)

    if model.bytes <= BROADCAST_BYTES:
        whole = df.sparkSession.sparkContext.broadcast(model.filter)

        def at_once(batches):
            for batch in batches:
                for group in token_groups(batch.column(len(keep))):
                    run = _Run([group], 1, with_pairs=False)
                    found = scores(run, *_looked_up(whole.value, run.words, run.pairs, run.at, run.before))
                    yield pa.RecordBatch.from_arrays([*(c.slice(group[0], len(group[1])) for c in batch.columns[: len(keep)]), *found], names=names)

        scored = df.select(*keep, text).mapInArrow(at_once, schema)
    else:
        rows = _chunked(df, keep, text)
        met = rows.select("_chunk", "_place", *keep, "_text").groupBy("_chunk").cogroup(_answers(rows, model).groupBy("_chunk"))
        scored = met.applyInArrow(finish, schema)
    scored = cut_lineage(scored.withColumn("_row", F.monotonically_increasing_id()))
    rare = scored.select("_row", F.explode("_tail").alias("word")).groupBy("_row", "word").agg(F.count("*").alias("_tf"))
    rare = rare.join(tail, "word", "left").groupBy("_row").agg(
        F.sum(F.col("_tf") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)).alias("_rest"),
        F.sum(F.when(F.col("n") > 0, F.col("_tf")).otherwise(0)).alias("_more"),
    )
    norm = float(np.log10(model.tokens + 0.5 * (model.distinct + 1)))
    return scored.drop("_tail").join(rare, "_row", "left").select(
        *keep, "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"), "score",
    )
