"""Lexical recall lanes, which find objects by their names and join the pool before re-ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmap.functions import paths, text
from strandmap.operators import lookup
from strandmap.plans import query_text
from strandmap.plans.retrieval import RankProfile, content_tokens, query_terms, rerank


def lane_of(query: str, prefix: str | None = None, profile: RankProfile | None = None) -> tuple[Column, Column]:
    """(lane, raw score) of an object, both null where no lane finds it: path or name of the whole query, exact names of its words or phrases, name stems of roots, all tokens.

    Middle-of-name stems only count below a prefix. A profile's intents and
    language add names, and stems below heads of paths. An object takes the first lane that finds it.
    """
    profile = profile or RankProfile()
    words = [t.word for t in query_terms(query)]
    tokens = content_tokens(query)
    aliases = [a for w in words for a in profile.aliases.get(w, [])] + query_text.alias_terms(query, profile.aliases)
    intents = profile.intended(query)
    aliases += [n for i in intents for n in i.names]
    headed = [spec for i in intents for spec in i.stems]
    if profile.language is not None:
        headed += query_text.stem_plan(query, profile.language, profile.long_stem_heads, profile.short_stem_heads)
    candidates = [query_text.fold(c) for c in query_text.name_candidates(query)]
    name = text.fold(F.col("name"))
    root = paths.is_root(F.col("path"))
    stems = [t[: max(6, len(t) - 2)] for t in tokens if len(t) >= 5]
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    named = [
        ("identifier", F.lit(4.0), (F.col("path") == query) | (F.col("name") == query)),
        ("name", F.lit(3.0), name.isin(*words, *candidates) | F.col("name").isin(aliases)),
        ("stem", F.lit(2.0), root & (some(F.startswith(name, F.lit(s)) for s in stems) | some(paths.strictly_under(F.col("path"), head) & F.startswith(name, F.lit(query_text.fold(s))) for head, s in headed))),
    ]
    if prefix is not None:
        named.append(("inside", F.lit(1.5), root & some(name.contains(s) for s in stems if len(s) >= 8)))
    named.append(("tokens", F.least(lookup.token_score(tokens) / 20.0, F.lit(1.0)), lookup.has_tokens(tokens)))
    return F.coalesce(*(F.when(test, lane) for lane, _, test in named)), F.coalesce(*(F.when(test, score) for _, score, test in named))


def lanes(objects: DataFrame, query: str, prefix: str | None = None, profile: RankProfile | None = None) -> DataFrame:
    """The objects that some lane finds, all of them, with lane and raw_score: one filter over the objects."""
    lane, score = lane_of(query, prefix, profile)
    rows = lookup.filter_objects(objects, prefix=prefix).withColumn("lane", lane).where(F.col("lane").isNotNull())
    return rows.withColumn("raw_score", score)


def strong_hits(hits: DataFrame, query: str, most: int) -> int:
    """How many roots among the hits, help pages aside, cover two content words of the query or its only one; counts to ``most``."""
    tokens = content_tokens(query)
    n = reduce(lambda a, b: a + b, (text.fold(F.concat_ws(" ", "name", "path")).contains(t).cast("int") for t in tokens), F.lit(0))
    return hits.where(paths.is_root(F.col("path")) & (F.col("kind") != "Help") & (n >= min(2, max(1, len(tokens))))).limit(most).count()


def strong(hits: DataFrame, query: str) -> bool:
    """Whether two root hits or more are strong: then help pages add nothing."""
    return strong_hits(hits, query, 2) == 2


def find(objects: DataFrame, query: str, prefix: str | None = None, limit: int = 20, profile: RankProfile | None = None) -> DataFrame:
    """The best objects of all that the lanes find."""
    return rerank(lanes(objects, query, prefix, profile), query, profile).orderBy(F.desc("score"), "path").limit(limit)
