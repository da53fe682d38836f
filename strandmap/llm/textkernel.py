"""Numpy kernels over the UTF-8 bytes of many texts at once.

All functions take the bytes of a slice of rows as one flat ``uint8`` array
with row offsets, as Arrow stores strings, so no Python object is made for a
word. Hashes are 64 bits wide and the same in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLD = U64(0x9E3779B97F4A7C15)

#: Space and the controls TAB, LF, VT, FF, CR separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=U64) + U64(seed) * U64(1_000_003)) | U64(1)


_BYTE_EXACT = mix(np.arange(256, dtype=U64) + U64(77_000))
_BYTE_LOWER = _BYTE_EXACT.copy()
_BYTE_LOWER[65:91] = _BYTE_EXACT[97:123]
_PLACE = _odd(3, 4096)


def _places(n: int) -> np.ndarray:
    global _PLACE
    if n > len(_PLACE):
        _PLACE = _odd(3, max(n, 2 * len(_PLACE)))
    return _PLACE


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and length of each word: a longest run of bytes outside ``space``."""
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    return np.searchsorted(offsets, starts, side="right") - 1, starts, lengths


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span; with ``lower``, A-Z hash as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    before = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(before, lengths)
    values = (_BYTE_LOWER if lower else _BYTE_EXACT)[data[place + np.repeat(starts, lengths)]]
    values *= _places(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, before) + lengths.astype(U64) * _GOLD)


_TURN = _odd(11, 64)


def shingles(rows: np.ndarray, words: np.ndarray, n_rows: int, width: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of ``width`` words.

    A row with fewer words, but one at least, has the hash of all its words.
    """
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    begins = ends - counts
    total = len(words)
    grams = np.zeros(0, U64)
    if total >= width:
        grams = np.zeros(total - width + 1, U64)
        for t in range(width):
            grams += words[t : total - width + 1 + t] * _TURN[t]
        grams = mix(grams + U64(width))
    out = []
    for begin, end in zip(begins.tolist(), ends.tolist(), strict=True):
        if end - begin >= width:
            out.append(np.unique(grams[begin : end - width + 1]))
        elif end > begin:
            short = words[begin:end]
            out.append(mix(np.array([(short * _TURN[: len(short)]).sum(dtype=U64)], U64) + U64(len(short))))
        else:
            out.append(np.zeros(0, U64))
    return out


def row_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    rows, starts, lengths = word_spans(data, offsets)
    return shingles(rows, span_hashes(data, starts, lengths), len(offsets) - 1, width)
