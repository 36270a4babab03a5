"""Words of whole Arrow text columns, found and hashed with numpy over the column's byte buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes between words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = ~inside[:-1]
    last[:-1] = ~inside[1:]
    first[offsets[:-1][offsets[:-1] < n]] = True
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 100_000) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a sum of byte and place constants, finalised with the length."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), step):  # bounds the arrays that hold a number per byte
        first, lengths = starts[k : k + step], ends[k : k + step] - starts[k : k + step]
        begin = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
        at = place + np.repeat(first, lengths)
        weights = constants(int(lengths.max()), 29)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(_BYTE[data[at]] * weights[place], begin)
            out[k : k + step] = mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return out


def pieces(column: pa.Array, most: int) -> list[tuple[int, int]]:
    """Row ranges of about `most` text bytes each; a longer text stands alone."""
    _, offsets = text_buffer(column)
    out, begin = [], 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        out.append((begin, end))
        begin = end
    return out
