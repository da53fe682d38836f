"""BPE encoding and decoding with the vocabulary file of a public tokenizer, in batched numpy rounds.

The file is the JSON of a word-level BPE: NFC, white space, lower case, a split
into contractions, letter runs, single digits and other runs, byte-level
symbols and an end-of-word suffix. The distinct words of many texts are encoded
together: their symbols lie in one flat array, each round looks up every
adjacent pair by binary search over the sorted pair keys, and merges the
lowest-ranked pair of every word at once.

Token ids are held as packed little-endian unsigned 32-bit integers in one
binary column; ``unpack_ids`` turns them into an array.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm import textkernel as K
from strandmap.llm.common import lean, ship, text_slices

U64 = np.uint64
_NEVER = np.iinfo(np.int64).max
#: Characters and words that are worked on or remembered at a time.
SLICE_CHARS, REMEMBERED = 500_000, 200_000

# Marks that no valid text holds: unpaired surrogates.
_FIRST_MARK = 0xD800
_ROW_END = 0xDFFF
_OTHER, _LETTER, _DIGIT, _SPACE, _MARK, _UNSEEN = range(6)
#: White space of the regular expressions' \s.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@dataclass
class Vocabulary:
    """Arrays of a vocabulary file: small, of a size that no data changes."""

    inner: np.ndarray  # id of each byte within a word
    final: np.ndarray  # id of each byte at a word's end
    pair_keys: np.ndarray  # left * size + right, sorted
    pair_ranks: np.ndarray
    pair_merged: np.ndarray
    size: int
    name: str
    specials: list[tuple[str, int]]
    token_bytes: np.ndarray  # the tokens' strings laid end to end
    token_offsets: np.ndarray


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
    specials = [(t["content"], t["id"]) for t in spec["added_tokens"]]
    size = 1 + max([*vocab.values(), *(i for _, i in specials)])
    symbols = _byte_symbols()
    left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]), strict=True))
    keys = left * size + right
    order = np.argsort(keys, kind="stable")
    strings = [""] * size
    for token, i in [*vocab.items(), *specials]:
        strings[i] = token
    encoded = [s.encode() for s in strings]
    return Vocabulary(
        inner=np.array([vocab[c] for c in symbols], np.int64),
        final=np.array([vocab[c + end] for c in symbols], np.int64),
        pair_keys=keys[order],
        pair_ranks=order.astype(np.int64),
        pair_merged=merged[order],
        size=size,
        name=path,
        specials=specials,
        token_bytes=np.frombuffer(b"".join(encoded), np.uint8),
        token_offsets=np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64),
    )


def merge_words(v: Vocabulary, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words and their number for each word; ``data`` are the words' UTF-8 bytes end to end."""
    n = len(lengths)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = v.inner[data]
    last = np.cumsum(lengths) - 1
    symbols[last] = v.final[data[last]]
    word = np.repeat(np.arange(n), lengths)
    done_symbols, done_words = [], []
    while len(symbols):
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        rank = np.full(len(symbols), _NEVER)
        key = symbols[:-1] * v.size + symbols[1:]
        at = np.searchsorted(v.pair_keys, key)
        at[at == len(v.pair_keys)] = 0
        hit = (v.pair_keys[at] == key) & (word[1:] == word[:-1])
        rank[:-1][hit] = v.pair_ranks[at[hit]]
        least = np.repeat(np.minimum.reduceat(rank, begins), np.diff(np.append(begins, len(symbols))))
        over = least == _NEVER
        if over.any():
            done_symbols.append(symbols[over])
            done_words.append(word[over])
        take = np.flatnonzero((rank == least) & ~over)
        # Of overlapping places (a a a) every second one from the left merges.
        fresh = np.concatenate([[True], np.diff(take) != 1]) if len(take) else np.zeros(0, bool)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(take)), 0)) if len(take) else take
        take = take[(np.arange(len(take)) - run) % 2 == 0]
        symbols[take] = v.pair_merged[at[take]]
        stay = ~over
        stay[take + 1] = False
        symbols, word = symbols[stay], word[stay]
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return symbols[order], np.bincount(word, minlength=n)


# Lower case of letters that Unicode 16 and 17 added, which Python's tables lack.
_NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {p: p + 0x20 for p in range(0x10D50, 0x10D66)} | {p: p + 0x1B for p in range(0x16EA0, 0x16EB9)}
# Blocks with letters and digits that Unicode 16 added.
_NEWER = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105FF), (0x10D40, 0x10D8F), (0x10EC2, 0x10EC4), (0x11380, 0x113FF), (0x116D0, 0x116E3), (0x11BC0, 0x11BFF), (0x13460, 0x143FA), (0x16100, 0x1613F), (0x16D40, 0x16D7F), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FF)]
_IS_LETTER, _IS_DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
_CLASS = np.full(0x110000, _UNSEEN, np.uint8)
_LOWER = np.arange(0x110000, dtype=np.uint32)


def _class_of(p: int) -> int:
    kind = unicodedata.category(chr(p))
    if kind == "Cn" and any(a <= p <= b for a, b in _NEWER):
        kind = "L" if _IS_LETTER.match(chr(p)) else "N" if _IS_DIGIT.match(chr(p)) else kind
    return {"L": _LETTER, "N": _DIGIT}.get(kind[0], _OTHER)


def _classes(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points and their classes."""
    new = np.unique(points[_CLASS[points] == _UNSEEN])
    for p in new.tolist():
        if 0xD800 <= p < 0xE000:
            _CLASS[p] = _MARK
            continue
        low = chr(_NEWER_LOWER.get(p, p)).lower()
        _LOWER[p] = ord(low) if len(low) == 1 else p
        for q in (p, int(_LOWER[p])):
            _CLASS[q] = _SPACE if q in _WHITE else _class_of(q)
    points = _LOWER[points]
    return points, _CLASS[points]


def split_words(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each word: contraction, letter run, digit, other run or mark."""
    n = len(points)
    before = np.concatenate([[_SPACE], kinds[:-1]])
    begin = ((kinds == _LETTER) & (before != _LETTER)) | (kinds == _DIGIT) | (kinds == _MARK) | ((kinds == _OTHER) & (before != _OTHER))
    quote = np.flatnonzero((points == 0x27) & begin)
    if len(quote):
        padded = np.concatenate([points, [0, 0, 0]])
        one, two = padded[quote + 1], padded[quote + 2]
        is_pair = np.isin(one, [ord(c) for c in "stmd"])
        is_three = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        span = np.where(is_pair, 2, np.where(is_three, 3, 0))
        quote, span = quote[span > 0], span[span > 0]
        begin[quote + 1] = False
        after = (quote + span)[quote + span < n]
        begin[after[kinds[after] == _LETTER]] = True
    edges = np.flatnonzero(begin | (kinds == _SPACE))
    starts = np.flatnonzero(begin)
    ends = np.append(edges, n)[np.searchsorted(edges, starts) + 1]
    return starts, ends - starts


class Encoder:
    """Encodes lists of texts and remembers a bounded number of words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, U64)
        self.slots = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)

    def _learn(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> None:
        before = np.cumsum(lengths) - lengths
        flat = points[np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)]
        width = 1 + (flat >= 0x80) + (flat >= 0x800) + (flat >= 0x10000)
        data = np.frombuffer(flat.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        ids, counts = merge_words(self.v, data, np.add.reduceat(width, before))
        known = len(self.offsets) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.slots = np.concatenate([self.slots, known + np.arange(len(hashes))])[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end and the number of ids of each."""
        marks = [(s, f"\n{chr(_FIRST_MARK + k)}\n") for k, (s, _) in enumerate(self.v.specials)]
        whole = f"\n{chr(_ROW_END)}\n".join(texts)
        for s, mark in marks:
            whole = whole.replace(s, mark)
        whole = unicodedata.normalize("NFC", whole).replace("İ", "i̇")
        points, kinds = _classes(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
        starts, lengths = split_words(points, kinds)
        first = points[starts] if len(starts) else np.zeros(0, np.uint32)
        row = np.cumsum(first == _ROW_END)
        stay = first != _ROW_END
        starts, lengths, first, row = starts[stay], lengths[stay], first[stay], row[stay]
        is_mark = kinds[starts] == _MARK
        counts = np.zeros(len(starts), np.int64)
        slot = np.zeros(len(starts), np.int64)
        plain = np.flatnonzero(~is_mark)
        if len(plain):
            s, k = starts[plain], lengths[plain]
            before = np.cumsum(k) - k
            place = np.arange(int(k.sum())) - np.repeat(before, k)
            values = (points[place + np.repeat(s, k)].astype(U64) + U64(1)) * K._places(int(k.max()))[place]
            hashes, where, back = np.unique(K.mix(np.add.reduceat(values, before) + k.astype(U64)), return_index=True, return_inverse=True)
            if len(self.hashes) > REMEMBERED:
                self._forget()
            new = np.ones(len(hashes), bool)
            if len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
                new = self.hashes[at] != hashes
            if new.any():
                self._learn(points, s[where[new]], k[where[new]], hashes[new])
            found = self.slots[np.searchsorted(self.hashes, hashes)]
            slot[plain] = found[back]
            counts[plain] = (self.offsets[1:] - self.offsets[:-1])[slot[plain]]
        counts[is_mark] = 1
        before = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        n = counts[plain]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[inner + np.repeat(before[plain], n)] = self.ids[inner + np.repeat(self.offsets[slot[plain]], n)]
        if is_mark.any():
            special = np.array([i for _, i in self.v.specials], np.uint32)
            out[before[is_mark]] = special[first[is_mark] - _FIRST_MARK]
        return out, np.bincount(row, weights=counts, minlength=len(texts)).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def _encoder(v: Vocabulary) -> Encoder:
    """The worker's own encoder, so that tasks that share a worker share its words."""
    if v.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[v.name] = Encoder(v)
    return _ENCODERS[v.name]


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the tokens joined by spaces, row by row, and the bytes of each row.

    Ids outside the vocabulary are left out.
    """
    row = np.repeat(np.arange(len(counts)), counts)
    ids = ids.astype(np.int64)
    known = ids < v.size
    ids, row = ids[known], row[known]
    begin = v.token_offsets[ids]
    size = v.token_offsets[ids + 1] - begin + 1
    total = int(size.sum())
    before = np.cumsum(size) - size
    inner = np.arange(total) - np.repeat(before - begin, size)
    out = v.token_bytes[np.minimum(inner, len(v.token_bytes) - 1)]
    ends = before + size - 1
    out[ends] = 0x20
    keep = np.ones(total, bool)
    keep[ends[np.flatnonzero(np.append(row[1:] != row[:-1], True))] if len(row) else []] = False
    sizes = np.bincount(row, weights=size, minlength=len(counts)).astype(np.int64)
    return out[keep], sizes - (np.bincount(row, minlength=len(counts)) > 0)


def _binary(data: np.ndarray, sizes: np.ndarray, kind=pa.binary()) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _shared(v: Vocabulary, df: DataFrame):
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(v)


def _columns(df: DataFrame, keep: list[str] | None, new: list[str], gone: str) -> list[str]:
    taken = [c for c in (df.columns if keep is None else keep)]
    return [c for c in taken if c not in new and c != gone]


def encode(docs: DataFrame, v: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text if None), n_tokens and ids (packed).

    Null texts count as empty and have no ids. Columns named n_tokens or ids
    are replaced. Rows stay as they are, repeated ones too; whole texts of any
    length are encoded.
    """
    others = _columns(docs, keep, ["n_tokens", "ids"], text)
    shared = _shared(v, docs)
    schema = T.StructType([docs.schema[c] for c in others]).add("n_tokens", "long").add("ids", "binary")

    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(others)).to_pylist()]
            for a, b in text_slices([len(x) + 3 for x in texts], SLICE_CHARS):
                ids, counts = encoder.encode(texts[a:b])
                packed = _binary(ids.astype("<u4").view(np.uint8), counts * 4)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(others))] + [pa.array(counts), packed], names=[*others, "n_tokens", "ids"])

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").alias("_text")).mapInArrow(lean(run), schema)


def decode(tokens: DataFrame, v: Vocabulary, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``tokens`` (all if None) and decoded: the tokens joined by spaces.

    Special tokens are not skipped. Null ids count as none and decode to an
    empty text. A column named decoded is replaced.
    """
    others = _columns(tokens, keep, ["decoded"], "")
    shared = _shared(v, tokens)
    schema = T.StructType([tokens.schema[c] for c in others]).add("decoded", "string")

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            data, offsets = K.flat(batch.column(len(others)))
            for a, b in text_slices(np.diff(offsets), SLICE_CHARS):
                part = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), "<u4")
                out, sizes = decode_ids(vocabulary, part, np.diff(offsets[a : b + 1]) // 4)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(others))] + [_binary(out, sizes, pa.string())], names=[*others, "decoded"])

    return tokens.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{ids}`").alias("_ids")).mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, v: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all but the text if None), n_tokens, ids and decoded.

    The same as ``decode(encode(docs))``, but one worker does both, so a task
    holds one worker's memory and ids don't cross to the JVM and back.
    """
    others = _columns(docs, keep, ["n_tokens", "ids", "decoded"], text)
    shared = _shared(v, docs)
    schema = T.StructType([docs.schema[c] for c in others]).add("n_tokens", "long").add("ids", "binary").add("decoded", "string")

    def run(batches):
        vocabulary = shared.value
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(others)).to_pylist()]
            for a, b in text_slices([len(x) + 3 for x in texts], SLICE_CHARS):
                ids, counts = encoder.encode(texts[a:b])
                out, sizes = decode_ids(vocabulary, ids, counts)
                packed = _binary(ids.astype("<u4").view(np.uint8), counts * 4)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(others))] + [pa.array(counts), packed, _binary(out, sizes, pa.string())], names=[*others, "n_tokens", "ids", "decoded"])

    return docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").alias("_text")).mapInArrow(lean(run), schema)


def unpack_ids(packed: F.Column) -> F.Column:
    """The packed ids as an array of integers."""
    digits = lambda i: F.hex(F.substring(packed, i * 4 + 1, F.lit(4)))
    word = lambda i: F.conv(F.concat(*(F.substring(digits(i), k, 2) for k in (7, 5, 3, 1))), 16, 10).cast("int")
    return F.when(F.length(packed) >= 4, F.transform(F.sequence(F.lit(0), (F.length(packed) / 4).cast("int") - 1), word)).otherwise(F.array().cast("array<int>"))
