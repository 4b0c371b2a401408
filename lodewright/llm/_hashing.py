"""Words of UTF-8 texts and 64-bit hashes of them, over whole Arrow batches in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those
bytes inside a longer character, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
RADIX = 0x9E3779B97F4A7C15 | 1
RADIX_INVERSE = pow(RADIX, -1, 1 << 64)
PIECE = 1 << 20
#: Words of a text column in SQL, A-Z in lower case.
SQL_WORDS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    m = (1 << 64) - 1
    x &= m
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def _radix_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 65536)
        _powers[:] = [np.cumprod(np.r_[U(1), np.full(size - 1, x, U)]) for x in (RADIX, RADIX_INVERSE)]
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and each row's offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of every word and the first word's index of each row, len(rows) + 1."""
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~space
    before = np.r_[False, inside[:-1]] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.r_[inside[1:], False] if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes = np.empty(len(starts), U)
    low = 0
    while low < len(starts):  # pieces that end with a word
        base = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        stop = int(ends[high - 1])
        part = data[base:stop]
        if lower:
            part = LOWER[part]
        up, down = _radix_powers(stop - base + 1)
        total = np.empty(stop - base + 1, U)
        total[0] = 0
        np.cumsum((part.astype(U) + U(1)) * up[: stop - base], out=total[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        hashes[low:high] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        low = high
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def utf8_at(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for chunks of a string column."""
    data, offsets = utf8(column)
    for low, high in row_chunks(offsets):
        base = offsets[low]
        yield low, high, data[base : offsets[high]], offsets[low : high + 1] - base
