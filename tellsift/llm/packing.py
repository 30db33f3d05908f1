"""Pack token pieces into sequences: best-fit decreasing per partition, certified by lower bounds.

Every document's ids end with one end id; only documents longer than a sequence are cut. Pieces are
dealt to partitions of about ``PART_ITEMS``; each partition packs best-fit decreasing and compares
its number of sequences with lower bounds from dual-feasible functions. Partitions that meet their
bound are certified and stay. The others give up the pieces of all sequences that aren't full, these
are dealt anew together and packed again, for as long as that takes fewer sequences. At last the emptiest
sequence of every partition joins what is still open in one more exchange, if that takes fewer.
"""

from __future__ import annotations

import os
import warnings
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tellsift.llm.common import cut_lineage

PART_ITEMS = 20_000
CACHE_WORDS, CACHE_BYTES = 1_000_000, 64 << 20
SLICE_BYTES = 4 << 20
#: A guard only: repacking that still saves sequences after so many rounds is given up with a warning.
ROUNDS = 100

_tokenizers: dict[str, object] = {}
_remembered: dict[str, "_Words"] = {}


@dataclass
class _Words:
    """Words and their ids, as arrays: some tens of bytes a word."""

    words: pa.Array
    sizes: np.ndarray
    ids: np.ndarray

    def joined(self, other: "_Words") -> "_Words":
        return _Words(
            pa.concat_arrays([self.words, other.words]), np.concatenate([self.sizes, other.sizes]), np.concatenate([self.ids, other.ids])
        )


def _encoded(words: pa.Array, path: str) -> _Words:
    found = _tokenizer(path).encode_batch_fast(words.to_pylist(), add_special_tokens=False)
    parts = [array("I", x.ids).tobytes() for x in found]
    sizes = np.array([len(x) >> 2 for x in parts], dtype=np.int64)
    return _Words(words, sizes, np.frombuffer(b"".join(parts), dtype="<u4"))


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about ``limit`` bytes; a longer row stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(ends):
        used = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, used + limit, "right")))
        yield row, texts.slice(row, stop - row)
        row = stop


def token_ids(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, rows' lengths), each row closed by ``end_id``.

    The tokenizer drops white space before it merges, so a text's ids are those of its words in turn.
    Each distinct word of a slice is looked up once. A worker remembers about the first ``CACHE_WORDS`` words it
    met, for all its tasks; this spares repeated work and changes no result.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    cache = _remembered.get(path) or _Words(words.slice(0, 0), np.zeros(0, np.int64), np.zeros(0, "<u4"))
    place = pc.index_in(words, value_set=cache.words)
    new = place.is_null().to_numpy(zero_copy_only=False)
    known = cache.joined(_encoded(words.filter(pa.array(new)), path))
    if len(cache.words) < CACHE_WORDS and known.words.nbytes < CACHE_BYTES:
        _remembered[path] = known
    place = pc.fill_null(place, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    place[new] = len(cache.words) + np.arange(new.sum())
    sizes, pool = known.sizes[place], known.ids
    firsts = (np.cumsum(known.sizes) - known.sizes)[place]
    n_ids = sizes[codes]
    upto = np.concatenate([[0], np.cumsum(n_ids)])
    ids = pool[np.repeat(firsts[codes] - upto[:-1], n_ids) + np.arange(upto[-1])]
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    lengths = np.diff(upto[offsets])
    out = np.full(len(ids) + len(lengths), end_id, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(len(lengths)), lengths)] = ids
    return out, lengths + 1


def token_pieces(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: key, piece, start, length, ids_crc32, and ``ids`` if wanted.

    Null and empty texts hold the end id alone. Rows with equal keys are separate documents.
    """
    kind = dict(df.dtypes)[key]
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                ids, lengths = token_ids(texts, path, end_id)
                pieces = -(-lengths // capacity)
                rows = np.repeat(np.arange(len(lengths)), pieces)
                number = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                size = np.minimum(capacity, lengths[rows] - start)
                begin = (np.cumsum(lengths) - lengths)[rows] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), size.tolist())]
                columns = [
                    batch.column(0).slice(first, len(lengths)).take(pa.array(rows)),
                    pa.array(number, pa.int32()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([bytes(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), size.tolist())], pa.binary()))
                names = [key, "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return df.select(key, text).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs at least: the best of three families of dual-feasible functions.

    The sum itself; for each e up to half the capacity, pieces over capacity - e counted as full and
    pieces under e as nothing; for k of 1 to 32, x rounded to floor((k + 1) x / capacity) / k.
    """
    if not len(lengths):
        return 0
    return _bound(np.bincount(lengths, minlength=capacity + 1), capacity)


def _bound(count: np.ndarray, capacity: int) -> int:
    """The same from the number of pieces of each length."""
    sizes = np.arange(capacity + 1)
    total = np.cumsum(count * sizes)
    number = np.cumsum(count)
    best = -(-int(total[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    full = number[-1] - number[capacity - e]
    between = total[capacity - e] - total[e - 1]
    best = max(best, int((-(-(full * capacity + between) // capacity)).max(initial=0)))
    for k in range(1, 33):
        exact = (sizes * (k + 1)) % capacity == 0
        value = np.where(exact, sizes * k, ((k + 1) * sizes // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each length, and the bins' fill. ``lengths`` come in falling order.

    Bit r of ``open_`` says that some bin has r places left, so the tightest bin is one bit search.
    """
    open_, left = 0, [[] for _ in range(capacity + 1)]
    bins, offsets, fill = [], [], []
    for n in lengths.tolist():
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = left[room].pop()
            if not left[room]:
                open_ ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(capacity - room)
        fill[b] += n
        if room > n:
            left[room - n].append(b)
            open_ |= 1 << (room - n)
    return np.array(bins, dtype=np.int64), np.array(offsets, dtype=np.int64), np.array(fill, dtype=np.int64)


def _pack(items: DataFrame, capacity: int, turn: int, groups: int) -> DataFrame:
    """One round: (_item, length) dealt to groups; adds sequence_id, offset, _fill, _gap and
    _least, 1 in the group's emptiest sequence."""

    def run(table: pa.Table) -> pa.Table:
        lengths, item = table["length"].to_numpy(), table["_item"].to_numpy()
        order = np.lexsort((item, -lengths))
        bins, offsets, fill = best_fit_decreasing(lengths[order], capacity)
        gap = len(fill) - lower_bound(lengths, capacity)
        number = (turn << 56) + (int(table["_group"][0].as_py()) << 24) + bins
        columns = {
            "_item": item[order], "length": lengths[order], "sequence_id": number, "offset": offsets,
            "_fill": fill[bins], "_gap": np.full(len(bins), gap), "_least": bins == fill.argmin(),
        }
        return pa.table({k: pa.array(np.asarray(v, dtype=np.int64)) for k, v in columns.items()})

    dealt = items.select("_item", "length").withColumn(
        "_group", F.pmod(F.xxhash64("_item", F.lit(turn)), F.lit(groups)).cast("long")
    )
    schema = "_item long, length long, sequence_id long, offset long, _fill long, _gap long, _least long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, part_items: int = PART_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``.

    Full pieces are sequences of their own. Others: as the module says. The rows are written down
    with a number each first, so that equal pieces are packed apart and a lost task packs alike.
    Ties in length go by that number. No rows: no rows.
    """
    pieces = cut_lineage(pieces.withColumn("_item", F.monotonically_increasing_id()))
    loose = pieces.where(F.col("length") < capacity).select("_item", "length")
    n_items = loose.count()
    packed = cut_lineage(_pack(loose, capacity, 1, -(-n_items // part_items) or 1))

    def exchanged(open_, turn: int) -> DataFrame | None:
        """The open sequences' pieces packed anew, if that takes fewer sequences."""
        released = packed.where(open_)
        n_items, before = released.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        if before < 2:
            return None
        again = cut_lineage(_pack(released, capacity, turn, -(-n_items // part_items)))
        return again if again.agg(F.count_distinct("sequence_id")).first()[0] < before else None

    partly, done, turn = F.col("_fill") < capacity, [], 2
    open_ = (F.col("_gap") > 0) & partly
    while (again := exchanged(open_, turn)) is not None:
        done.append(packed.where(~open_))
        packed, turn = again, turn + 1
        if turn > rounds:
            warnings.warn(f"packing stopped after {rounds} rounds that all saved sequences", stacklevel=2)
            break
    for rest in done:
        packed = packed.unionByName(rest)
    emptiest = (F.col("_least") == 1) & partly
    for last in (open_ | emptiest, emptiest):
        if (again := exchanged(last, turn)) is not None:
            packed = packed.where(~last).unionByName(again)
            break
    alone = pieces.where(F.col("length") >= capacity).select(
        "_item", (-1 - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    placed = packed.select("_item", "sequence_id", "offset").unionByName(alone)
    return pieces.join(placed, "_item").drop("_item")


def sequences_and_bound(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Sequences of packed pieces, and how many any packing of all of them together needs at least."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for row in packed.groupBy("length").count().collect():  # at most ``capacity`` rows
        count[row["length"]] = row["count"]
    return packed.agg(F.count_distinct("sequence_id")).first()[0], _bound(count, capacity)


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False, **options) -> DataFrame:
    """Tokenize, cut and pack: one row per piece with its sequence and place there."""
    return pack_pieces(token_pieces(df, path, capacity=capacity, with_ids=with_ids, **options), capacity)
