"""Alignment of the tokens of two tokenizers, A and B, over the same bytes.

The byte ranges of B's tokens are a static interval index: sorted ends and
starts. Every token of A stabs it by bisection and gets the list of tokens of B
that it overlaps. A gap between tokens of A that no such list spans is a
boundary of groups; the tokens of both sides between two boundaries form a
group, and each token of A in it is linked with each token of B in it.

Texts are cut where a character that is no white space is followed by a space.
Both tokenizers cut there too, whatever stands around, so each distinct segment
of a slice of texts is encoded and aligned once, however often it occurs.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.llm.common import free_name, lean, ship, spread, stored, text_slices

#: Distinct segments that a worker remembers, their characters in all, and characters of one that is remembered.
KNOWN, KNOWN_CHARS, LONGEST = 200_000, 8_000_000, 200
#: Characters of texts that are aligned at once.
_SLICE = 500_000
#: Id pairs whose counts are broadcast at most, 17 bytes each.
BROADCAST_PAIRS = 500_000
#: Links of a group that are written out one by one at most; larger groups multiply counts of ids.
_PLAIN = 65_536

#: A space, white space after it, and all up to the next space that follows a character other than white space.
_SEGMENT = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves, others for code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Sides:
    """Both tokenizers in a worker, with the bytes of their tokens."""

    a_path: str
    b_path: str

    def __post_init__(self):
        import sentencepiece

        spec = json.load(open(self.a_path, encoding="utf-8"))  # noqa: SIM115
        letters = _byte_letters()
        vocab = {t: i for t, i in spec["model"]["vocab"].items()}
        self.a_bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for t, i in vocab.items():
            if all(c in letters for c in t):
                self.a_bytes[i] = bytes(letters[c] for c in t)
        self._fast = _ranked(spec, vocab, self.a_bytes)
        self._slow = None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=self.b_path)
        self.b_bytes = [_piece_bytes(self.pieces.id_to_piece(i)) for i in range(self.pieces.get_piece_size())]
        # A piece that goes on after a space would join what segments cut.
        self.whole = any("▁" in self.pieces.id_to_piece(i).lstrip("▁") for i in range(len(self.b_bytes)))
        self.a_lengths = np.array([len(t) for t in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(t) for t in self.b_bytes], np.int64)

    def segments(self, text: str) -> list[str]:
        """Segments of a text that begins with a space."""
        if self.whole:
            return [text]
        parts = _SEGMENT.findall(text)
        if len(parts) > 1 and parts[-1] == " ":  # alone it would be an empty text, to which B adds nothing
            parts[-2:] = [parts[-2] + " "]
        return parts

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        if self._fast is not None:
            return [self._fast.encode_ordinary(t) for t in texts]
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.a_path)
            self._slow.encode_special_tokens = True
            self._slow.no_truncation()
            self._slow.no_padding()
        return [self._slow.encode(t, add_special_tokens=False).ids for t in texts]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Encode texts without the space before them, which this tokenizer adds."""
        return self.pieces.encode([t[1:] for t in texts], num_threads=1)


def _piece_bytes(piece: str) -> bytes:
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


def _ranked(spec: dict, vocab: dict[str, int], token_bytes: list[bytes]):
    """The byte-level tokenizer by ranks, where ids rise with merges: the same tokens at several times the speed. Else None."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab.get(a + b, -1) for a, b in merges]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("ignore_merges")
    if not plain or model.get("dropout") or any(x >= y for x, y in zip(made[:-1], made[1:], strict=True)) or -1 in made[:1]:
        return None
    try:
        import public_tokenizers
        import tiktoken
    except ImportError:
        return None
    specials = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {token_bytes[i]: i for t, i in vocab.items() if t not in specials}
    first = min(made, default=256)
    if len(ranks) != 256 + len(merges) or any(len(token_bytes[i]) != 1 for i in ranks.values() if i < first):
        return None
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whole numbers from each begin on, so many as its size says, laid end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def groups_of(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from 0, where both sides cover the same bytes; no token is empty."""
    a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
    a_starts, b_starts = a_ends - a_lengths, b_ends - b_lengths
    first = np.searchsorted(b_ends, a_starts, side="right")
    last = np.searchsorted(b_starts, a_ends, side="left") - 1
    cut = np.ones(len(a_ends), bool)
    cut[1:] = last[:-1] < first[1:]  # else a token of B spans the gap
    a_group = np.cumsum(cut) - 1
    b_group = np.searchsorted(a_starts[cut], b_starts, side="right") - 1
    return a_group, b_group


def _written(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, p: np.ndarray, q: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Groups of each segment as ``a1,a2|b1;a3|b2``: all digits are set at once, each token with the sign after it."""
    start = np.cumsum(p + q) - (p + q)
    at_a = start[a_group] + np.arange(len(a)) - (np.cumsum(p) - p)[a_group]
    at_b = (start + p)[b_group] + np.arange(len(b)) - (np.cumsum(q) - q)[b_group]
    ids, signs = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    signs[start + p - 1], signs[start + p + q - 1] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    power = 10
    while (more := ids >= power).any():
        digits += more
        power *= 10
    ends = np.cumsum(digits + 1)
    out = np.zeros(int(ends[-1]), np.uint8)
    out[ends - 1] = signs
    left, k = ids, 0
    while (here := digits > k).any():
        out[ends[here] - 2 - k] = ord("0") + left[here] % 10
        left, k = left // 10, k + 1
    whole = out.tobytes()
    cuts = [*(ends - digits - 1)[start[first]].tolist(), len(whole)]
    return [whole[i : j - 1] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _linked(a: np.ndarray, b: np.ndarray, a_group: np.ndarray, p: np.ndarray, q: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, pair of ids, links that have it), sorted and distinct; ``owner`` is the segment of each token of A."""
    large = p * q > _PLAIN
    plain = ~large[a_group]
    begins = np.cumsum(q) - q
    sizes = q[a_group[plain]]
    keys = [np.repeat(a[plain] << 32, sizes) | b[_ranges(begins[a_group[plain]], sizes)]]
    owners, times = [np.repeat(owner[plain], sizes)], [np.ones(len(keys[0]), np.int64)]
    a_begins = np.cumsum(p) - p
    for g in np.flatnonzero(large).tolist():  # counts of ids are multiplied, links are not written out
        x, in_a = np.unique(a[a_begins[g] : a_begins[g] + p[g]], return_counts=True)
        y, in_b = np.unique(b[begins[g] : begins[g] + q[g]], return_counts=True)
        keys.append(((x[:, None] << 32) | y[None]).ravel())
        times.append((in_a[:, None] * in_b[None]).ravel())
        owners.append(np.full(len(keys[-1]), owner[a_begins[g]]))
    owner, key, n = np.concatenate(owners), np.concatenate(keys), np.concatenate(times)
    order = np.lexsort((key, owner))
    owner, key, n = owner[order], key[order], n[order]
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
    return owner[heads], key[heads], np.add.reduceat(n, heads)


class Aligned:
    """Aligned segments of a worker: numbers, written groups and linked pairs of each, by the segment's number."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((0, 5), np.int64)  # fine, n_a, n_b, n_groups, n_links
        self.written: list[bytes] = []
        self.bounds = np.zeros(1, np.int64)  # of the pairs of each segment
        self.keys = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def add(self, segments: list[str]) -> None:
        """Align segments that are not known yet, all at once."""
        s, n = self.sides, len(segments)
        a_rows, b_rows = s.encode_a(segments), s.encode_b(segments)
        raw = [t.encode() for t in segments]
        fine = np.array([b"".join(map(s.a_bytes.__getitem__, a)) == r == b"".join(map(s.b_bytes.__getitem__, b)) for a, b, r in zip(a_rows, b_rows, raw, strict=True)], bool)
        use = np.flatnonzero(fine)
        n_a, n_b = (np.array([len(rows[i]) for i in use.tolist()], np.int64) for rows in (a_rows, b_rows))
        a, b = (np.fromiter(chain.from_iterable(rows[i] for i in use.tolist()), np.int64) for rows in (a_rows, b_rows))
        table = np.zeros((n, 5), np.int64)
        written, bounds = [b""] * n, np.zeros(n + 1, np.int64)
        keys = times = np.zeros(0, np.int64)
        if len(use):
            # Segments lie end to end on both sides, so their ends are boundaries of groups too.
            a_group, b_group = groups_of(s.a_lengths[a], s.b_lengths[b])
            first = a_group[np.cumsum(n_a) - n_a]
            p, q = np.bincount(a_group), np.bincount(b_group)
            table[use] = np.stack([np.ones(len(use), np.int64), n_a, n_b, np.diff(np.append(first, len(p))), np.add.reduceat(p * q, first)], axis=1)
            for i, text in zip(use.tolist(), _written(a, b, a_group, b_group, p, q, first), strict=True):
                written[i] = text
            owner, keys, times = _linked(a, b, a_group, p, q, np.repeat(use, n_a))
            bounds[1:] = np.cumsum(np.bincount(owner, minlength=n))
        self.number |= zip(segments, range(len(self.written), len(self.written) + n), strict=True)
        self.chars += sum(map(len, segments))
        self.written += written
        self.table = np.concatenate([self.table, table])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + bounds[1:]])
        self.keys, self.times = np.concatenate([self.keys, keys]), np.concatenate([self.times, times])

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the segments of all texts, laid end to end, and bounds of each text; null and empty texts have none."""
        if len(self.number) > KNOWN or self.chars > KNOWN_CHARS:
            self.clear()
        parts = [self.sides.segments(" " + t) if t else [] for t in texts]
        known = self.number
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in known]
        if new:
            self.add(new)
        out = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64)
        for p in new:
            if len(p) > LONGEST:  # its text is not kept; its alignment stays until the next clearing
                del known[p]
        return out, np.cumsum([0, *map(len, parts)])

    def documents(self, texts: list[str | None]):
        """(n_a, n_b, n_groups, n_links) of each text, the digest of its groups, and its distinct pairs with their numbers of links."""
        segments, bounds = self.numbers(texts)
        facts = self.table
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        fine = np.bincount(owner, weights=facts[segments, 0] == 0, minlength=len(texts)) == 0
        sums = np.stack([np.bincount(owner, weights=facts[segments, i], minlength=len(texts)).astype(np.int64) for i in range(1, 5)], axis=1)
        sums[~fine] = 0
        digests = []
        for i in range(len(texts)):
            part = segments[bounds[i] : bounds[i + 1]].tolist()
            digests.append(hashlib.sha256(b";".join(map(self.written.__getitem__, part))).hexdigest() if part and fine[i] else "")
        use = fine[owner]
        spots, often = np.unique(owner[use] * len(facts) + segments[use], return_counts=True)
        row, segment = np.divmod(spots, max(len(facts), 1))
        used, which = np.unique(segment, return_inverse=True)
        begins, sizes = self.bounds[used], self.bounds[used + 1] - self.bounds[used]
        picked = _ranges(begins, sizes)
        keys, times = self.keys[picked], self.times[picked]
        each = sizes[which]
        place = _ranges((np.cumsum(sizes) - sizes)[which], each)
        distinct, pair = np.unique(keys, return_inverse=True)
        cells = np.repeat(row, each) * max(len(distinct), 1) + pair[place]
        weights = times[place] * np.repeat(often, each)
        order = np.argsort(cells, kind="stable")
        cells, weights = cells[order], weights[order]
        heads = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        weights = np.add.reduceat(weights, heads) if len(cells) else weights
        row, pair = np.divmod(cells[heads], max(len(distinct), 1))
        cuts = np.searchsorted(row, np.arange(len(texts) + 1))
        return sums, digests, distinct[pair], weights, cuts


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, byte plane by byte plane, so that planes of zeros compress to nothing."""
    return b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns)


def _unpack(data: bytes, n_columns: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(n_columns, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(n_columns, -1)


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (all if None) with n_a, n_b, n_groups, n_links, groups_sha256 and linked_pairs.

    A is a byte-level tokenizers file and encodes a space and the text, special
    tokens as plain text; B is a sentencepiece model that adds this space.
    groups_sha256 is the digest of ``a1,a2|b1;a3|b2,b3``. linked_pairs packs the
    distinct linked id pairs (a << 32 | b), as differences, and how many links
    have them. Null and empty texts, and texts whose tokens on some side don't
    join to the same bytes, have no tokens: zeros, an empty digest, no pairs.
    Rows stay as they are; columns of the new names are replaced.
    """
    ship(docs.sparkSession)
    new = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "linked_pairs"]
    others = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([docs.schema[c] for c in others])
    for name, kind in zip(new, ["long"] * 4 + ["string", "binary"], strict=True):
        schema = schema.add(name, kind)

    def run(batches):
        known = Aligned(Sides(a_path, b_path))
        for batch in batches:
            texts = batch.column(len(others)).to_pylist()
            for i, j in text_slices([len(t or "") for t in texts], _SLICE):
                sums, digests, keys, times, cuts = known.documents(texts[i:j])
                pairs = [_pack(np.diff(keys[a:b], prepend=0), times[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                columns = [*(batch.column(c).slice(i, j - i) for c in range(len(others))), *(pa.array(sums[:, c]) for c in range(4)), pa.array(digests), pa.array(pairs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, *new])

    rows = docs.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").alias("_text"))
    return spread(rows, docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(lean(run), schema)


def _unpacked(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and numbers of links of all rows, laid end to end, and the row of each."""
    rows = [_unpack(data, 2) for data in column.to_pylist()]
    sizes = [r.shape[1] for r in rows]
    keys = np.concatenate([np.cumsum(r[0]) for r in rows] or [np.zeros(0, np.int64)])
    times = np.concatenate([r[1] for r in rows] or [np.zeros(0, np.int64)])
    return keys.astype(np.int64), times.astype(np.int64), np.repeat(np.arange(len(rows)), sizes)


def _count_documents(batches):
    """(pair, documents that hold it), summed over a task, handed on whenever they are many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged():
        keys, where = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, where, np.concatenate([n for _, n in held]))
        return keys, n

    for batch in batches:
        keys, _, _ = _unpacked(batch.column(0))  # a row's pairs are distinct
        held.append(np.unique(keys, return_counts=True))
        size += len(held[-1][0])
        if size > 2_000_000:
            held = [merged()]
            size = len(held[0][0])
            if size > 1_000_000:
                yield _pair_batch(*held[0])
                held, size = [], 0
    if held:
        yield _pair_batch(*merged())


def _pair_batch(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["pair", "n"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents an id pair is linked, and whether its id of A has no pair with more.

    Tasks sum before they shuffle. The highest counts are a row for each id of
    A, so they are broadcast: a vocabulary bounds them.
    """
    counts = aligned.select("linked_pairs").mapInArrow(lean(_count_documents), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts, "alignment-pairs").withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _least_hot(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that ``most`` pairs or fewer have so many documents, from as many rows as a count has bits."""
    rows = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).count().collect()
    total, least = 0, 2**62
    for r in sorted(rows, key=lambda r: -r.bits):
        total += r["count"]
        if total > most:
            break
        least = 2**r.bits
    return least


def with_counts(aligned: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """``aligned`` with n_best and count_sum instead of linked_pairs.

    Every row is a document, also one with a repeated or null id. count_sum adds
    the counts of the pairs of all links, n_best counts links whose pair has the highest count of its id of A. Counts of the most frequent
    pairs, ``most`` at the most, are broadcast and looked up where the documents
    are; links of all rarer pairs meet their counts in a join.
    """
    spark = aligned.sparkSession
    row = free_name(aligned, "_row")
    kept = stored(aligned.withColumn(row, F.monotonically_increasing_id()), "alignment")
    counts = stored(pair_counts(kept), "alignment-counts")
    least = _least_hot(counts, most)
    hot = counts.where(F.col("n") >= least).toArrow()  # 'most' rows at the most
    pairs = hot.column("pair").to_numpy()
    order = np.argsort(pairs)
    shared = spark.sparkContext.broadcast((pairs[order], hot.column("n").to_numpy()[order], hot.column("best").to_numpy(zero_copy_only=False)[order]))

    def known(column):
        keys, times, owner = _unpacked(column)
        pairs, n, best = shared.value
        at = np.minimum(np.searchsorted(pairs, keys), max(len(pairs) - 1, 0))
        found = pairs[at] == keys if len(pairs) else np.zeros(len(keys), bool)
        return keys, times, owner, at, found, n, best

    others = [c for c in kept.columns if c.lower() not in (row.lower(), "linked_pairs", "n_best", "count_sum")]
    best_here, sum_here = free_name(kept, "_best"), free_name(kept, "_sum")
    schema = T.StructType([kept.schema[c] for c in [row, *others]]).add(best_here, "long").add(sum_here, "long")

    def look_up(batches):
        for batch in batches:
            keys, times, owner, at, found, n, best = known(batch.column("linked_pairs"))
            at, times, owner = at[found], times[found], owner[found]
            n_best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(n_best, owner, times * best[at])
            np.add.at(total, owner, times * n[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [row, *others]), pa.array(n_best), pa.array(total)], names=schema.names)

    def rare(batches):
        for batch in batches:
            keys, times, owner, _, found, _, _ = known(batch.column("linked_pairs"))
            rows = batch.column(row).to_numpy()[owner[~found]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(keys[~found]), pa.array(times[~found])], names=["row", "pair", "times"])

    near = kept.mapInArrow(lean(look_up), schema)
    out = [F.col(f"`{c}`") for c in others]
    if counts.where(F.col("n") < least).isEmpty():
        return near.select(*out, F.col(best_here).alias("n_best"), F.col(sum_here).alias("count_sum"))
    far = kept.select(row, "linked_pairs").mapInArrow(lean(rare), "row long, pair long, times long").join(counts.where(F.col("n") < least), "pair")
    far = far.groupBy(F.col("row").alias(row)).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    both = near.join(far, row, "left")
    return both.select(*out, *((F.col(here) + F.coalesce(c, F.lit(0))).alias(c) for here, c in ((best_here, "n_best"), (sum_here, "count_sum"))))
