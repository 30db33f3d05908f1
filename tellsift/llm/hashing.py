"""Words of Arrow text columns as 64-bit hashes, worked out on whole buffers with numpy.

A word is a run of ``[^\\x20\\x09-\\x0D]``; A-Z count as a-z. A word's hash is a polynomial over its
bytes, modulo 2**64, followed by a mixing step. All words of a slice of the buffer come from one
running sum, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
#: 0: white space, 1: letters, digits and all beyond ASCII, 2: other signs.
_CLASS = np.array([0 if _SPACE[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[65:91] = values[97:123]
    values[_SPACE] = 0
    return values


_BYTES = _byte_values()
_powers: dict[str, np.ndarray] = {}


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        for name, step in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, step, dtype=np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null row is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _hashes(data: np.ndarray, starts_of_rows: np.ndarray, classes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in ``data``; a row's start also parts two words.

    With ``classes`` a word also ends where letters and digits meet other signs.
    """
    kind = _CLASS[data] if classes else (~_SPACE[data]).view(np.uint8)
    solid = kind > 0
    change = kind[1:] != kind[:-1]
    first = solid.copy()
    first[1:] &= change
    last = solid.copy()
    last[:-1] &= change
    inner = starts_of_rows[(starts_of_rows > 0) & (starts_of_rows < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _tables(max(SLICE, 1 << int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * down[starts])


def _long_row(data: np.ndarray, classes: bool) -> np.ndarray:
    """Word hashes of one long row, slice by slice, cut between words."""
    parts, at, none = [], 0, np.zeros(0, dtype=np.int64)
    while at < len(data):
        stop = min(at + SLICE, len(data))
        reach = stop
        while stop < len(data) and reach < len(data):
            gaps = np.flatnonzero(_SPACE[data[at if reach == stop else reach - SLICE : reach]])
            if len(gaps):
                stop = (at if reach == stop else reach - SLICE) + int(gaps[-1]) + 1
                break
            reach = min(reach + SLICE, len(data))
            if reach == len(data):
                stop = reach
            else:
                continue
        parts.append(_hashes(data[at:stop], none, classes)[1])
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def word_groups(texts: pa.Array, limit: int = SLICE, classes: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words per row, hashes of those words) for runs of whole rows of about ``limit`` bytes."""
    data, offsets = buffers(texts)
    rows, row = len(offsets) - 1, 0
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, rows)
        begin, end = int(offsets[row]), int(offsets[stop])
        if end - begin > 2 * limit:
            hashes = _long_row(data[begin:end], classes)
            counts = np.array([len(hashes)])
        else:
            bounds = offsets[row : stop + 1] - begin
            starts, hashes = _hashes(data[begin:end], bounds, classes)
            counts = np.diff(np.searchsorted(starts, bounds))
        yield row, counts, hashes
        row = stop


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each row's run of ``values``."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
