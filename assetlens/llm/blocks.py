"""Arrow text columns as flat byte arrays, cut into blocks of bounded size, and the words in them.

Every operator that needs Python takes its rows through :func:`text_blocks`: a worker holds one
block of text at a time (a single longer text is a block of its own), whatever the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SMALL_BLOCK = 1 << 18  # where stages share their workers, whose memory stays at the highest of them
_MULT, _SEED = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def text_blocks(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches whose column number ``text`` holds about ``limit`` bytes, with that text laid flat."""
    for batch in batches:
        data, offsets = flat_text(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            lo, hi = offsets[at], offsets[end]
            yield batch.slice(at, end - at), data[lo:hi], offsets[at : end + 1] - lo
            at = end


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(_MULT)
    inverse = np.uint64(pow(_MULT, -1, 1 << 64))

    def table(b):
        out = np.full(n, b, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(base), table(inverse)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit rolling hash of each span values[start:end], from one prefix sum over all of them."""
    n = len(values)
    size = 1 << max(16, int(n + 1).bit_length())
    power, inverse = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return splitmix(h + (ends - starts).astype(np.uint64) * np.uint64(_SEED))


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``inside`` that do not cross a row's border: starts, ends, and each row's first run number."""
    n = len(inside)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words made of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every row of a block: starts, ends, each row's first word number, and 64-bit hashes."""
    starts, ends, first = spans(kind[data], offsets)
    return starts, ends, first, span_hashes(LOWER[data] if lower else data, starts, ends)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' first item numbers."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[start : start + length] of every pair, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return flat[:0]
    at = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - at, lengths) + np.arange(total)]


def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list column of flat values."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))
