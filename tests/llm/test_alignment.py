import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmap.llm import alignment, queries

A, B = queries.vocabulary_path("byte_bpe_50k.json"), queries.vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens_of(libraries, sides, text):
    """Whole texts through the libraries; none where the bytes differ."""
    t, p = libraries
    if not text:
        return [], []
    a, b = t.encode(" " + text, add_special_tokens=False).ids, p.encode(text)
    raw = (" " + text).encode()
    same = b"".join(sides.a_bytes[i] for i in a) == raw == b"".join(sides.b_bytes[i] for i in b)
    return (a, b) if same else ([], [])


def brute(libraries, sides, texts):
    docs, holders = [], Counter()
    for text in texts:
        a, b = tokens_of(libraries, sides, text)
        ends = [np.cumsum([sides.a_bytes[i].__len__() for i in a]).tolist(), np.cumsum([len(sides.b_bytes[i]) for i in b]).tolist()]
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = [(p, q) for x, y in groups for p in x for q in y]
        holders.update(set(links))
        docs.append((a, b, groups, links))
    top = defaultdict(int)
    for (p, _), n in holders.items():
        top[p] = max(top[p], n)
    out = []
    for a, b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(holders[p, q] == top[p] for p, q in links), sum(holders[p, q] for p, q in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def hostile(n, seed=3):
    rng = random.Random(seed)
    pieces = ["the ", "naïve", "  ", "\n", "\n\n  x", "\t", "  ", "漢字", "é", "😀👍🏽", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "it's", "I'LL", "12345", " 3.14", "....", " ", "\x1c", "\x85", "　", "ſ", "ﬁ", "–", " –", "a" * 40, "\r\n", "Ω", "ß", "߷", "᠎", "​", "!?", "'s ", "_", "﻿", "x\x00y"]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_segments_encode_as_whole_texts(libraries):
    sides = alignment.Sides(A, B)
    assert sides._fast is not None and not sides.whole
    for text in hostile(4000) + [" x", "  ", "x ", "▁a", "a▁b c"]:
        parts = sides.segments(" " + text)
        assert "".join(parts) == " " + text
        assert [i for x in sides.encode_a(parts) for i in x] == libraries[0].encode(" " + text, add_special_tokens=False).ids
        assert [i for x in sides.encode_b(parts) for i in x] == libraries[1].encode(text)


def test_every_letter_encodes_alike(libraries):
    """Ranks and the tokenizers library split words alike at all characters."""
    sides = alignment.Sides(A, B)
    letters = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}b {c}1{c}{c}" for c in letters[i : i + 64]) for i in range(0, len(letters), 64)]
    differ = [t for t, x in zip(texts, sides.encode_a(texts), strict=True) if libraries[0].encode(t, add_special_tokens=False).ids != x]
    assert not differ


def test_groups_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        cuts = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, n + 1)), n)) for _ in range(2)]
        shared = np.intersect1d(*cuts)
        got = alignment.groups_of(*(np.diff(c, prepend=0) for c in cuts))
        for c, g in zip(cuts, got, strict=True):
            assert g.tolist() == np.searchsorted(shared, c).tolist()


@pytest.mark.parametrize("most", [500_000, 40, 0])
def test_alignment_by_brute_force(spark, libraries, monkeypatch, most):
    monkeypatch.setattr(alignment, "_PLAIN", 6)
    monkeypatch.setattr(alignment, "_SLICE", 700)
    texts = [None, "", " ", "the cat", "the cat", "the cat sat on the mat " * 40, "ab" * 3000, "▁", "done▁", "y" * 500 + " z"] + hostile(150, 8)
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)] + [(None, "the cat", "x", "y", "z"), (3, "the cat", "x", "y", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string, _best string, count_sum string").repartition(3)
    out = alignment.with_counts(alignment.align(df, A, B), most)
    assert out.columns == ["doc_id", "text", "_best", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    sides = alignment.Sides(A, B)
    want = Counter(zip([r[0] for r in rows], brute(libraries, sides, [r[1] for r in rows]), strict=True))
    got = Counter((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in out.collect())
    assert got == want
    assert alignment.with_counts(alignment.align(df.limit(0), A, B)).count() == 0


def test_hot_pairs_are_bounded(spark):
    counts = spark.createDataFrame([(i, 2 ** (i % 12)) for i in range(240)], "pair long, n long")
    for most in (0, 19, 20, 57, 240):
        least = alignment._least_hot(counts, most)
        assert counts.where(F.col("n") >= least).count() == most // 20 * 20


def test_op12_on_whole_table(spark, sf, libraries):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = dict(zip(docs, brute(libraries, alignment.Sides(A, B), list(docs.values())), strict=True))
    out = queries.op12_alignment(spark, sf)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in out.collect()} == want
