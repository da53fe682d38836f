"""Hashed text features for the classifiers, made from the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from strandmap.llm import textkernel as K

U64 = np.uint64
#: All ASCII but letters separates the words that the toxicity model sees.
_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[:128] = True
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = False


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
        out[after] += 32
    return out


def word_and_prefix_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, prefixes: range) -> np.ndarray:
    """One row a word: the hash of the word, then of each proper prefix of so many bytes (0 where the word is no longer)."""
    out = np.zeros((len(starts), 1 + len(prefixes)), U64)
    if not len(starts):
        return out
    out[:, 0] = K.span_hashes(data, starts, lengths, lower=False) | U64(1)
    for i, k in enumerate(prefixes, 1):
        long = np.flatnonzero(lengths > k)
        if not len(long):
            break
        h = np.zeros(len(long), U64)
        for t in range(k):
            h += K._BYTE_EXACT[data[starts[long] + t]] * K._PLACE[t]
        out[long, i] = K.mix(h + U64(k)) & ~U64(1) | U64(2)
    return out


def letter_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes, (row, word) of each word of letters, and first byte and length of each different word."""
    data = lower_latin(data)
    rows, starts, lengths = K.word_spans(data, offsets, _NOT_LETTER)
    hashes = K.span_hashes(data, starts, lengths, lower=False)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    return data, rows, back, starts[first], lengths[first]


# Classes of bytes in a word's shape: letter, capital, digit, beyond ASCII; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = ord("a"), ord("A"), ord("9"), ord("a")


def style_features(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed feature of each word, its shape, and of each word that repeats the one before.

    A shape is the run of byte classes with repeats of one class left out.
    """
    rows, starts, lengths = K.word_spans(data, offsets)
    words = K.span_hashes(data, starts, lengths)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    s = kept_before[starts]
    shapes = K.span_hashes(shape[keep], s, kept_before[starts + lengths] - s, lower=False)
    again = np.flatnonzero((words[1:] == words[:-1]) & (rows[1:] == rows[:-1])) + 1
    all_rows = np.concatenate([rows, rows, rows[again]])
    hashes = np.concatenate([K.mix(words ^ U64(1)), K.mix(shapes ^ U64(2)), np.full(len(again), 12345, U64)])
    return all_rows, (hashes % U64(size)).astype(np.int64)
