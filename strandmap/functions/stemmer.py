"""Stems of Russian words by the Snowball rules, for many words at once.

Words are rows of a matrix of letters. The endings of a rule are a tree over
their letters from the last one on, so one walk of as many steps as the longest
ending has letters finds every word's longest ending.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vowels and endings of the Snowball stemmer for Russian. Endings of the first of two groups have to follow а or я.
_VOWELS = "аеиоуыэюя"
_GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
_ADJECTIVE = ("", "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
_REFLEXIVE = ("", "ся сь")
_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_NOUN = ("", "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")
_DERIVED = ("", "ост ость")
_SUPERLATIVE = ("", "ейш ейше")

#: Longer words are left as they are.
LONGEST = 64
_OTHER = 33  # letters other than а to я


class Endings:
    """A tree of endings, read backwards: ``step[node, letter]`` is the next node, 0 for none."""

    def __init__(self, after_a: str, plain: str):
        nodes: list[dict[int, int]] = [{}, {}]  # 0 is no node, 1 the root
        accepts = {}
        for group, endings in ((1, after_a.split()), (2, plain.split())):
            for ending in endings:
                at = 1
                for letter in reversed(ending):
                    nxt = nodes[at].setdefault(ord(letter) - ord("а"), len(nodes))
                    if nxt == len(nodes):
                        nodes.append({})
                    at = nxt
                accepts[at] = group
        self.step = np.zeros((len(nodes), _OTHER + 1), np.int64)
        for at, edges in enumerate(nodes):
            for letter, nxt in edges.items():
                self.step[at, letter] = nxt
        self.group = np.array([accepts.get(i, 0) for i in range(len(nodes))])
        self.depth = max(len(e) for e in f"{after_a} {plain}".split())

    def cut(self, words: np.ndarray, ends: np.ndarray, starts: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New ends of the words, and which have lost their longest ending; only words ``on`` are touched, only what follows ``starts`` is looked at."""
        rows = np.arange(len(words))
        node, best, group = np.ones(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for k in range(1, self.depth + 1):
            inside = ends - k >= starts
            letter = words[rows, np.maximum(ends - k, 0)]
            node = np.where(inside, self.step[node, letter], 0)
            hit = self.group[node] > 0
            best[hit], group[hit] = k, self.group[node[hit]]
        before = ends - best - 1
        letter = words[rows, np.maximum(before, 0)]
        follows = (before >= starts) & np.isin(letter, _AFTER)
        found = on & (best > 0) & ((group == 2) | follows)
        return np.where(found, ends - best, ends), found


_LETTER = {c: i for i, c in enumerate(map(chr, range(ord("а"), ord("я") + 1)))}
_AFTER = np.array([_LETTER["а"], _LETTER["я"]])
_IS_VOWEL = np.isin(np.arange(_OTHER + 1), [_LETTER[c] for c in _VOWELS])
_RULES = {name: Endings(*groups) for name, groups in (("gerund", _GERUND), ("adjective", _ADJECTIVE), ("participle", _PARTICIPLE), ("reflexive", _REFLEXIVE), ("verb", _VERB), ("noun", _NOUN), ("derived", _DERIVED), ("superlative", _SUPERLATIVE))}


def _after(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Place behind the first true column at or after each start; the width if there is none."""
    columns = np.arange(mask.shape[1])
    hit = mask & (columns >= starts[:, None])
    return np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, mask.shape[1])


def stems(words: list[str]) -> list[str]:
    """Stems of folded words; words without a Russian vowel, and very long ones, are their own."""
    if not words:
        return []
    width = max(1, min(LONGEST, max(map(len, words))))
    lengths = np.array([len(w) if len(w) <= LONGEST else 0 for w in words])
    codes = np.array([w if n else "" for w, n in zip(words, lengths.tolist(), strict=True)], f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)
    m = codes - ord("а")
    m[(m < 0) | (m >= _OTHER)] = _OTHER
    within = np.arange(width) < lengths[:, None]
    vowel, other = _IS_VOWEL[m] & within, ~_IS_VOWEL[m] & within
    zero = np.zeros(len(words), np.int64)
    rv = _after(vowel, zero)
    r1 = _after(other, rv)
    r2 = _after(other, _after(vowel, r1))
    ends, everything = lengths.copy(), np.ones(len(words), bool)
    ends, done = _RULES["gerund"].cut(m, ends, rv, everything)
    ends, _ = _RULES["reflexive"].cut(m, ends, rv, ~done)
    ends, adjective = _RULES["adjective"].cut(m, ends, rv, ~done)
    ends, _ = _RULES["participle"].cut(m, ends, rv, adjective)
    done |= adjective
    for name in ("verb", "noun"):
        ends, found = _RULES[name].cut(m, ends, rv, ~done)
        done |= found
    rows = np.arange(len(words))
    last = lambda k, letter: (ends - k >= rv) & (m[rows, np.maximum(ends - k, 0)] == _LETTER[letter])
    ends = ends - last(1, "и")
    ends, _ = _RULES["derived"].cut(m, ends, r2, everything)
    ends, superlative = _RULES["superlative"].cut(m, ends, rv, everything)
    doubled = last(1, "н") & last(2, "н")
    soft = ~superlative & ~doubled & last(1, "ь")
    ends = ends - (doubled | soft)
    return [w[:e] if n else w for w, e, n in zip(words, ends.tolist(), lengths.tolist(), strict=True)]


def russian(word: str) -> str:
    """The stem of one folded word."""
    return stems([word])[0]


@F.pandas_udf(T.StringType())
def stem_of(terms: pd.Series) -> pd.Series:
    """Stems of a column of folded words; null stays null."""
    known = terms.dropna()
    distinct = known.drop_duplicates().tolist()
    return terms.map(dict(zip(distinct, stems(distinct), strict=True)))
