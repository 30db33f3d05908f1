"""Runs of repeated words in whole texts, found by internal pattern matching.

A run is a stretch of consecutive words with smallest period q and at least ``max(least, times * q)`` words that no
neighbouring word extends keeping the period. For B = 2, 4, 8, ... every run with B / 2 < q <= B (q = 1 belongs to
B = 2) holds a whole dyadic block of B words, one that starts at a multiple of B, and the block occurs once more in the
run, q words before or after. The occurrences of a block in the windows of B words on either side form a progression
whose difference is the distance to the nearest one, so that distance is the only candidate for q. Blocks ask for their
nearest occurrences by range successor and predecessor in a wavelet matrix over the suffix array; a block's range is its
group of suffixes when prefix doubling has sorted them by B words. Progressions that overlap by a period are joined,
then extended word by word at both ends.

Texts are cut into words exactly, words are compared by value, and all documents of an Arrow batch are worked on in
groups of about ``GROUP`` words (a longer document is a group of its own), shortest first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

GROUP = 1 << 17
#: Vector steps when progressions are extended; the few that go on are finished one by one.
STEPS = 8


class Wavelet:
    """Wavelet matrix over whole numbers below ``2 ** bits``; ranges and answers are arrays."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for shift in reversed(range(bits)):
            one = (values >> shift & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((shift, zeros))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values of each range are less than its bound."""
        count = np.zeros(len(low), dtype=np.int64)
        for shift, zeros in self.levels:
            one = (bound >> shift & 1).astype(bool)
            a, b = zeros[low], zeros[high]
            count += np.where(one, b - a, 0)
            low, high = np.where(one, low - a + zeros[-1], a), np.where(one, high - b + zeros[-1], b)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of each range that k others of it precede."""
        value = np.zeros(len(low), dtype=np.int64)
        for shift, zeros in self.levels:
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k = k - np.where(one, b - a, 0)
            low, high = np.where(one, low - a + zeros[-1], a), np.where(one, high - b + zeros[-1], b)
            value += one.astype(np.int64) << shift
        return value


def _groups(slots: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First slot and size of the group of each of the sorted keys."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.append(firsts, len(key)))
    return np.repeat(slots[firsts], sizes), np.repeat(sizes, sizes)


def _blocks(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list]:
    """The suffix array, sorted as deep as blocks reach, and per block length the blocks that occur again: their
    places and ranges. Only suffixes whose first two words occur again are sorted further."""
    n, longest = len(code), int((end - begin).max())
    place = np.arange(n)
    after = np.where(place + 1 < end, np.append(code[1:], 0) + 1, 0)
    key = code * (n + 1) + after
    array = np.argsort(key, kind="stable")
    slots = place
    first, size = _groups(slots, key[array])
    rank = np.empty(n, dtype=np.int64)
    rank[array] = first
    found, length = [], 2
    while length * 2 <= longest:
        again = size > 1
        slots, first, size = slots[again], first[again], size[again]
        if not len(slots):
            break
        at = array[slots]
        aligned = (at - begin[at]) % length == 0
        found.append((length, at[aligned], first[aligned], (first + size)[aligned]))
        beyond = at + length
        inside = beyond < end[at]
        key = rank[at] * (n + 1) + np.where(inside, rank[np.where(inside, beyond, 0)] + 1, 0)
        order = np.argsort(key, kind="stable")
        array[slots] = at[order]
        first, size = _groups(slots, key[order])
        rank[at[order]] = first
        length *= 2
    return array, found


def _progressions(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of stretches that keep a candidate period."""
    none = np.zeros(0, dtype=np.int64)
    array, found = _blocks(code, begin, end)
    if not found:
        return none, none, none
    # slots in no block's range are left out of the matrix
    asked = np.zeros(len(code) + 1, dtype=np.int64)
    for _, _, low, high in found:
        asked += np.bincount(low, minlength=len(asked)) - np.bincount(high, minlength=len(asked))
    held = np.cumsum(asked[:-1]) > 0
    slot = np.concatenate([[0], np.cumsum(held)])
    values = (array - begin[array])[held]
    if not len(values):
        return none, none, none
    matrix = Wavelet(values, max(1, int(values.max()).bit_length()))
    at = np.concatenate([x[1] for x in found])
    size = np.concatenate([np.full(len(x[1]), x[0]) for x in found])
    low, high = (slot[np.concatenate([x[i] for x in found])] for i in (2, 3))
    here = at - begin[at]
    before = matrix.below(low, high, here)
    starts, ends, periods = [], [], []
    for chosen, k, sign in ((before + 1 < high - low, before + 1, 1), (before > 0, before - 1, -1)):
        p, b = at[chosen], size[chosen]
        d = sign * (matrix.smallest(low[chosen], high[chosen], k[chosen]) - here[chosen])
        near = (d <= b) & ((2 * d > b) | (b == 2))
        p, b, d = p[near], b[near], d[near]
        starts.append(p if sign > 0 else p - d)
        ends.append(p + b + d if sign > 0 else p + b)
        periods.append(d)
    start, stop, period = (np.concatenate(x) for x in (starts, ends, periods))
    if not len(start):
        return none, none, none
    order = np.lexsort((start, period))
    start, stop, period = start[order], stop[order], period[order]
    # of one period all stretches are equally long, so ends rise with starts
    new = np.ones(len(start), dtype=bool)
    new[1:] = (period[1:] != period[:-1]) | (start[1:] + period[1:] > stop[:-1])
    firsts = np.flatnonzero(new)
    lasts = np.append(firsts[1:], len(start)) - 1
    return start[firsts], stop[lasts], period[firsts]


def _extend(code: np.ndarray, at: np.ndarray, period: np.ndarray, limit: np.ndarray, step: int) -> np.ndarray:
    """The furthest places, up to ``limit``, to which the words keep their distance to the word a period back."""
    at, going = at.copy(), np.arange(len(at))
    for _ in range(STEPS):
        x, d = at[going], period[going]
        room = x < limit[going] if step > 0 else x > limit[going]
        going, x, d = going[room], x[room], d[room]
        same = code[x] == code[x - d] if step > 0 else code[x - 1] == code[x - 1 + d]
        going = going[same]
        at[going] += step
    for i in going.tolist():
        x, d, stop, width = int(at[i]), int(period[i]), int(limit[i]), 64
        while x != stop:
            if step > 0:
                y = min(stop, x + width)
                bad = np.flatnonzero(code[x:y] != code[x - d : y - d])
                x = x + int(bad[0]) if len(bad) else y
            else:
                y = max(stop, x - width)
                bad = np.flatnonzero(code[y:x] != code[y + d : x + d])
                x = y + int(bad[-1]) + 1 if len(bad) else y
            if len(bad):
                break
            width *= 2
        at[i] = x
    return at


def runs_of(code: np.ndarray, bounds: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs, by start and period. ``code`` holds the words of documents one after the
    other as numbers from 0 that no two documents share, ``bounds`` where each begins and the last ends."""
    sizes = np.diff(bounds)
    begin, end = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    if not len(code):
        return (np.zeros(0, dtype=np.int64),) * 3
    start, stop, period = _progressions(code, begin, end)
    if len(start):
        low, high = begin[start], end[start]
        start, stop = _extend(code, start, period, low, -1), _extend(code, stop, period, high, 1)
    long = stop - start >= np.maximum(least, times * period)
    found = np.unique(np.stack([start[long], period[long], stop[long]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _coded(texts: list[bytes | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    words, parts, bounds, base = [], [np.zeros(0, dtype=np.int64)], [0], 0
    for text in texts:
        found = (text or b"").split()
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        parts.append(np.fromiter(map(known.__getitem__, found), dtype=np.int64, count=len(found)) + base)
        base += len(known)
        words.append(found)
        bounds.append(bounds[-1] + len(found))
    return words, np.concatenate(parts), np.array(bounds)


def _found(texts: list[bytes | None], least: int, times: int) -> Iterator[tuple[int, list[dict], bytes]]:
    """Per text the number of words, its runs and the text without repetitions."""
    words, code, bounds = _coded(texts)
    start, stop, period = runs_of(code, bounds, least, times)
    edge = np.zeros(len(code) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, stop, -1)
    kept = np.cumsum(edge[:-1]) == 0
    first = np.searchsorted(start, bounds)
    for i, found in enumerate(words):
        low, a, b = int(bounds[i]), first[i], first[i + 1]
        spans = [
            {"start": s - low, "length": e - s, "period": p}
            for s, e, p in zip(start[a:b].tolist(), stop[a:b].tolist(), period[a:b].tolist())
        ]
        if spans:
            found = [found[j] for j in np.flatnonzero(kept[low : bounds[i + 1]]).tolist()]
        yield len(words[i]), spans, b" ".join(found)


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), least: int = 6, times: int = 4) -> DataFrame:
    """The columns ``keep``, ``n_words``, ``runs`` (start, length and period in words, by start and period) and
    ``collapsed``: the text's words, joined by one space, without those that lie in a run after its first period.

    A null or blank text has no words, no runs and an empty collapsed text. Rows are judged each for itself, repeated
    ones alike; other columns of the input are left out, whatever their names. ``times`` is at least 4.
    """
    if times < 4:
        raise ValueError("a run of fewer than four periods need not hold a dyadic block")
    arrow_run = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([
        *fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
    ])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.large_binary())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            order = np.argsort(sizes, kind="stable")
            # a word and its gap take at least two bytes; most take about six
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[order]) // (6 * GROUP)) > 0) + 1
            for rows in np.split(order, cuts):
                if not len(rows):
                    continue
                chosen = pa.array(rows)
                found = list(_found(texts.take(chosen).to_pylist(), least, times))
                columns = [batch.column(i).take(chosen) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(arrow_run)),
                     pa.array([x[2] for x in found], pa.binary()).cast(pa.string())],
                    names=[*keep, "n_words", "runs", "collapsed"],
                )

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(work, schema)
