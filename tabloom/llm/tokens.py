"""Words, hashes and shingles of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once, so that the arrays of a step stay small; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: The white space that separates words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A 64-bit value for each byte; white space counts as nothing.
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_BYTE[_SPACE] = 0
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(ends, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, raw[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high


class Words:
    """The words of a chunk: start, end and row of each, and where each row's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        inside = ~_SPACE[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            first[cut] = inside[cut]
            last[cut - 1] = inside[cut - 1]
        self.data, self.starts = data, np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.rows = np.repeat(np.arange(len(offsets) - 1), np.diff(self.bounds))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of every word, of its letters A-Z in lower case if asked."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        sizes = self.ends - self.starts
        powers = np.cumprod(np.full(int(sizes.max()), _MULTIPLIER, np.uint64))
        lead = int(self.starts[0])
        value = (_LOWER if lower else _BYTE)[self.data[lead:]]
        gaps = np.diff(np.append(self.starts, len(self.data)))
        place = np.arange(len(value)) - np.repeat(self.starts - lead, gaps)
        value *= powers[np.minimum(place, len(powers) - 1)]  # behind a word stands white space, which counts as 0
        sums = np.add.reduceat(value, self.starts - lead)
        return mixed(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, their bounds per row): every ``k`` words, or all words of a row with fewer."""
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    joined = mixed(hashes)
    for step in range(1, k):
        nxt = np.zeros(n, np.uint64)
        if n > step:
            nxt[:-step] = hashes[step:]
        place = np.arange(n) - bounds[:-1][rows] if n else np.empty(0, np.int64)
        within = place + step < counts[rows]
        joined = np.where(within, mixed(joined * _MULTIPLIER + nxt), joined)
    place = np.arange(n) - bounds[:-1][rows] if n else np.empty(0, np.int64)
    keep = np.where(counts[rows] >= k, place + k <= counts[rows], place == 0)
    joined, rows = joined[keep], rows[keep]
    order = np.lexsort((joined, rows))
    joined, rows = joined[order], rows[order]
    new = np.ones(len(joined), bool)
    if len(joined) > 1:
        new[1:] = (joined[1:] != joined[:-1]) | (rows[1:] != rows[:-1])
    joined, rows = joined[new], rows[new]
    return joined, np.searchsorted(rows, np.arange(len(counts) + 1))
