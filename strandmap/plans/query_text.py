"""What a question's wording tells about names: stems, quoted and typed names, candidates, aliases.

All of it runs on one short string in the driver and ends as literals in a plan.
The stemmer and word lists belong to a language, which is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from heapq import nlargest

from strandmap.functions import stemmer

_WORD = re.compile(r"[^\W_]+")
_QUOTED = re.compile(r"«([^»]{2,80})»|\"([^\"]{2,80})\"|“([^”]{2,80})”")


#: Letters that a stem has at least to find names by, and from which on it is long.
LEAST_STEM, LONG_STEM = 4, 8


@dataclass(frozen=True)
class Language:
    """How words are stemmed, words too common to name anything, and words of processes rather than things."""

    weak: frozenset[str] = frozenset()
    process: frozenset[str] = frozenset()
    stem: Callable[[str], str] = stemmer.russian

    def passes_over(self, word: str) -> bool:
        """Whether a word, in any form, names nothing by itself."""
        return self.stem(fold(word)) in {self.stem(fold(w)) for w in self.weak | self.process}


def fold(text: str) -> str:
    return text.casefold().replace("ё", "е")


def words(query: str) -> list[str]:
    return list(dict.fromkeys(_WORD.findall(fold(query))))


def name_stem(token: str, language: Language) -> str:
    """The stem of a word as a name would begin with it; empty if it is too short to tell names apart."""
    stem = language.stem(fold(token))
    return stem.capitalize() if len(stem) >= LEAST_STEM else ""


def quoted(query: str) -> list[str]:
    """Spans in quotation marks."""
    return [next(g for g in m.groups() if g).strip() for m in _QUOTED.finditer(query)]


def bracketed(query: str) -> list[str]:
    return [m.strip() for m in re.findall(r"\(([^)]{2,80})\)", query)]


def is_enumeration(text: str) -> bool:
    """Whether a text lists three things or more, so that it names none of them by itself."""
    return len([p for p in re.split(r",|;|\s(?:и|and|or|или)\s", text) if p.strip()]) >= 3


def camel(phrase: str) -> str:
    """The words of a phrase run together with capitals."""
    return "".join(w[:1].upper() + w[1:] for w in _WORD.findall(phrase))


def name_candidates(query: str, longest: int = 4) -> list[str]:
    """Names that two to ``longest`` neighbouring words may stand for; quoted spans come first, lists give none."""
    spans = [s for s in quoted(query) if not is_enumeration(s)]
    rest = _WORD.findall(_QUOTED.sub(" ", query)) if not is_enumeration(query) else []
    runs = [camel(" ".join(rest[i : i + n])) for n in range(min(longest, len(rest)), 1, -1) for i in range(len(rest) - n + 1)]
    return list(dict.fromkeys([*map(camel, spans), *runs]))


def typed_entities(query: str, kinds: Mapping[str, str]) -> list[tuple[str, str]]:
    """(kind, name) of each quoted span behind a word for a kind, by the beginnings of such words."""
    out = []
    for m in _QUOTED.finditer(query):
        before = _WORD.findall(fold(query[: m.start()]))[-1:]
        name = camel(next(g for g in m.groups() if g))
        out += [(kind, name) for stem, kind in kinds.items() if before and before[0].startswith(stem)]
    return list(dict.fromkeys(out))


def alias_terms(query: str, aliases: Mapping[str, list[str]]) -> list[str]:
    """Names that aliases give to a query: of one word by the beginning of a token, of several if all of its words begin some token."""
    tokens = words(query)
    found = []
    for alias, names in aliases.items():
        if all(any(t.startswith(part) for t in tokens) for part in words(alias)):
            found += names
    return list(dict.fromkeys(found))


def _evidence(query: str, language: Language) -> dict[str, float]:
    """What speaks for each stem of a query: that a quoted span, or one in brackets, has a word of that stem, and its length."""
    marks = [(3.0, quoted(query)), (2.0, bracketed(query))]
    told = {stem: weight for weight, spans in reversed(marks) for span in spans for stem in (name_stem(w, language) for w in words(span))}
    stems = dict.fromkeys(name_stem(w, language) for w in words(query) if not language.passes_over(w))
    return {s: told.get(s, 0.0) + min(len(s), 20) / 20 for s in stems if s}


def stem_plan(query: str, language: Language, long_trees: tuple[str, ...], short_trees: tuple[str, ...], quota: int = 2) -> list[tuple[str, str]]:
    """(tree, stem) pairs to look for, those with most evidence first.

    Long stems are looked for in the long trees, others in the short trees, and
    each kind has ``quota`` stems, so neither crowds the other out.
    """
    worth = _evidence(query, language)
    plan = []
    for trees, fits in ((long_trees, lambda s: len(s) >= LONG_STEM), (short_trees, lambda s: len(s) < LONG_STEM)):
        plan += [(worth[s], s, trees) for s in nlargest(quota, filter(fits, worth), key=worth.__getitem__)]
    plan.sort(key=lambda p: -p[0])
    return [(tree, stem) for _, stem, trees in plan for tree in trees]
