"""Full-text and vector retrieval, fusion by reciprocal ranks, and explainable re-ranking."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import paths, text
from strandmap.plans.query_text import Language

K1, B, RRF_K = 1.2, 0.75, 60


@dataclass(frozen=True)
class Term:
    word: str
    prefix: bool = False


def query_terms(query: str, expand_from: int | None = None, aliases: dict[str, list[str]] | None = None, most_extra: int = 6) -> list[Term]:
    """Distinct folded words of a query; words of ``expand_from`` letters or more match as prefixes; aliases add terms."""
    words = list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower().replace("ё", "е"))))
    extra = [a for w in words for a in (aliases or {}).get(w, [])]
    terms = [Term(w, expand_from is not None and len(w) >= expand_from) for w in words]
    return terms + [Term(a) for a in dict.fromkeys(extra) if a not in words][:most_extra]


def _hits(tokens: Column, term: Term) -> Column:
    # size of null is null, so texts without the term keep a null here
    test = (lambda t: F.startswith(t, F.lit(term.word))) if term.prefix else (lambda t: t == term.word)
    return F.size(F.filter(tokens, test))


def bm25(docs: DataFrame, terms: list[Term], text_col: str = "text") -> DataFrame:
    """``docs`` with some term, with raw_score by BM25.

    For texts without an index (see ``index.TextIndex``). One pass counts
    documents, lengths and document frequencies of the query's terms; a second
    scores. Nothing is exploded or shuffled, and only texts that hold a term as
    a substring are taken apart into words.
    """
    folded = text.fold(F.col(text_col))
    likely = reduce(lambda a, b: a | b, (folded.contains(t.word) for t in terms), F.lit(False))
    split = docs.withColumn("_tokens", F.when(likely, text.tokens(F.col(text_col))))
    hits = [F.coalesce(_hits(F.col("_tokens"), t), F.lit(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
    words = F.regexp_count(F.col(text_col), F.lit(r"[\p{L}\p{N}]+"))
    stats = split.select(words.alias("_len"), *hits).agg(F.count("*").alias("n"), F.avg("_len").alias("avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    counted = split.where(likely).select(*docs.columns, F.size("_tokens").alias("_len"), *hits)

    found = reduce(lambda a, b: a | b, (F.col(f"_tf{i}") > 0 for i in range(len(terms))), F.lit(False))
    score = okapi(stats["n"], float(stats["avg"] or 1.0), [stats[f"df{i}"] for i in range(len(terms))])
    return counted.where(found).withColumn("raw_score", score).drop("_len", *(f"_tf{i}" for i in range(len(terms))))


def okapi(n: int, average: float, df: list[int]) -> Column:
    """The BM25 score of a row with its length _len and the counts _tf0, _tf1, ... of the terms."""

    def part(i: int) -> Column:
        tf = F.col(f"_tf{i}").cast("double")
        idf = F.log(F.lit(1 + (n - df[i] + 0.5) / (df[i] + 0.5)))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_len") / F.lit(average)))

    return reduce(lambda a, b: a + b, (part(i) for i in range(len(df))), F.lit(0.0))


def cosine(vectors: DataFrame, query: list[float], vector_col: str = "embedding") -> DataFrame:
    """``vectors`` with raw_score, the cosine with the query in double precision; vectors of another length are left out."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(vector_col).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))
    return vectors.where(F.size(vector_col) == len(query)).withColumn("raw_score", F.when(norm > 0, dot(v, q) / norm).otherwise(0.0))


def top(hits: DataFrame, k: int, key: str, score: str = "raw_score") -> DataFrame:
    """The best k hits, ties by key; every task keeps k rows only."""
    return hits.orderBy(F.desc(score), F.col(key)).limit(k)


def ranked(hits: DataFrame, k: int, key: str, score: str = "raw_score") -> DataFrame:
    """The best k hits with ranks from 1; k is some hundreds, so one task may number them."""
    return top(hits, k, key, score).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.col(key))))


def fuse(legs: list[DataFrame], key: str, pool: int, k: int = RRF_K, tie: str | None = None) -> DataFrame:
    """(key, score): the sum of 1 / (k + rank) over the best ``pool`` hits of each leg, equal ones ranked by ``tie`` (the key unless told)."""
    tie = tie or key
    parts = reduce(DataFrame.unionByName, (ranked(leg.select(*{key, tie}, "raw_score"), pool, tie).select(key, (1.0 / (k + F.col("rank"))).alias("s")) for leg in legs))
    return parts.groupBy(key).agg(F.sum("s").alias("score"))


@dataclass(frozen=True)
class Rule:
    """A boost or penalty for hits of a kind of query: all stated conditions must hold.

    Caps bound other terms of the hits for which the rule holds, so that these can't rescue them.
    """

    name: str
    weight: float
    query: str = ""  # regular expression on the query
    tokens_from: int = 0  # the query has so many content tokens or more
    kinds: tuple[str, ...] = ()
    name_like: str = ""  # regular expression on the name
    path_like: str = ""  # and on the path
    roots_only: bool = False
    nested_only: bool = False
    no_cover: bool = False  # only hits without any query token
    covers: tuple[int, int] | None = None  # hits that cover between so many tokens
    unless_lane: bool = False  # hits that a lane found by name or stem are spared
    caps: dict[str, float] = field(default_factory=dict)  # by name of another term


@dataclass(frozen=True)
class Intent:
    """What a kind of question is about: names to find outright, and stems of names to find below given heads of paths."""

    query: str  # regular expression on the query
    names: tuple[str, ...] = ()
    stems: tuple[tuple[str, str], ...] = ()  # (head, stem)


@dataclass(frozen=True)
class RankProfile:
    """Weights of the re-ranking; vocabularies of a product belong here, not into code."""

    coverage: float = 4.0
    kind_boost: dict[str, float] = field(default_factory=lambda: {"Document": 1.2, "Catalog": 1.2, "Report": 1.15, "DataCompositionSchema": 0.9, "CommonModule": 0.6})
    root_boost: float = 0.45
    howto_root: float = 0.15
    exact_root: float = 1.35
    exact_floor: float = 0.95  # coverage that an exact root has at least
    alias: float = 1.6
    alias_floor: float = 0.9  # and a report found by an alias
    multi_token: float = 1.25
    multi_step: float = 0.35
    multi_most: float = 0.7
    zero_cover: float = -2.6
    help_owner: float = 1.1
    named_lane: float = 1.5
    stem_lane: float = 1.3
    weak_singleton: float = -1.35
    rich_singleton: float = -1.2
    rich_from: int = 5
    camel_tail: float = -1.15
    extension_penalty: float = -0.8
    extension_margin: float = 1.15
    howto: str | None = None  # queries that ask how something is done; None for no query
    weak_words: frozenset[str] = frozenset()
    aliases: dict[str, list[str]] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    intents: tuple[Intent, ...] = ()
    language: Language | None = None  # with it, distinctive words of a query give stems below these heads
    long_stem_heads: tuple[str, ...] = ()
    short_stem_heads: tuple[str, ...] = ()

    def intended(self, query: str) -> list[Intent]:
        return [i for i in self.intents if re.search(i.query, query, re.IGNORECASE)]


#: Lanes that name a hit outright, and the one that finds it by the stem of a word.
NAMED_LANES, STEM_LANE = ("identifier", "name", "inside"), "stem"


def content_tokens(query: str, least: int = 6) -> list[str]:
    """Tokens of ``least`` letters or more, all if there are none."""
    words = [t.word for t in query_terms(query)]
    return [w for w in words if len(w) >= least] or words


def _covered(query: str) -> tuple[Column, int]:
    hay = text.fold(F.concat_ws(" ", "name", "synonym", "comment", "path"))
    tokens = content_tokens(query)
    return reduce(lambda a, b: a + b, (hay.contains(t).cast("int") for t in tokens), F.lit(0)), len(tokens)


def coverage(query: str) -> Column:
    """Share of tokens covered, and specificity: short names that cover all of several tokens gain most."""
    n, total = _covered(query)
    share = n / F.lit(float(max(1, total)))
    specific = F.when((n == total) & (F.lit(total) > 1), 0.35 + F.least(F.length("name"), F.lit(80)) / 200.0).when(share >= 0.5, 0.15 * share).otherwise(0.0)
    return share + specific


def _unmatched_tail(tokens: list[str]) -> Column:
    """Whether a CamelCase name has a part that no query token explains: an abbreviation, or a word that starts unlike all."""
    parts = text.camel_segments(F.col("name"))

    def alien(part: Column) -> Column:
        low = text.fold(part)
        known = reduce(lambda a, b: a | b, (low.contains(t) | F.lit(t).contains(low) for t in tokens), F.lit(False))
        near = reduce(lambda a, b: a | b, (F.startswith(low, F.lit(t[:4])) for t in tokens if len(t) >= 4), F.lit(False))
        short = part.rlike(r"^\p{Lu}{2,5}$")
        return ~known & (short | ((F.length(low) >= 5) & ~near))

    return (F.size(parts) >= 2) & F.exists(parts, alien)


def features(query: str, profile: RankProfile, lanes: bool = False, owners: bool = False) -> dict[str, Column]:
    """Every term of the re-ranking by name, so that a score can be explained.

    lanes: hits have a column lane; owners: they have owner_hit, whether a help
    page of the pool belongs to them.
    """
    n, total = _covered(query)
    root = paths.is_root(F.col("path"))
    kind = F.lit(0.0)
    for k, w in profile.kind_boost.items():
        kind = F.when(F.col("kind") == k, w).otherwise(kind)
    name = text.fold(F.col("name"))
    folded = query.lower().replace("ё", "е").strip()
    words = [t.word for t in query_terms(query)]
    howto = profile.howto is not None and re.search(profile.howto, query, re.IGNORECASE) is not None
    by_lane = F.col("lane").isin(*NAMED_LANES, STEM_LANE) if lanes else F.lit(False)
    spared = F.coalesce(by_lane, F.lit(False))
    exact = root & (F.length(name) >= 3) & name.isin(folded, *words)
    aliases = [a.lower().replace("ё", "е") for w in words for a in profile.aliases.get(w, [])]
    report = (F.col("kind") == "Report") & root
    alias = reduce(lambda a, b: a | b, ((name == a) | (root & name.contains(a)) | (report & F.lit(a).contains(name)) for a in aliases), F.lit(False))
    covered = coverage(query)
    covered = F.when(alias & report, F.greatest(covered, F.lit(profile.alias_floor))).otherwise(covered)
    covered = F.when(exact, F.greatest(covered, F.lit(profile.exact_floor))).otherwise(covered)
    when = lambda test, weight: F.when(test, weight).otherwise(0.0)
    out = {
        "coverage": profile.coverage * covered,
        "kind": kind,
        "root": when(root, profile.root_boost + (profile.howto_root if howto else 0.0)),
        "exact_root": when(exact, profile.exact_root),
        "alias": when(alias, profile.alias),
        "multi_token": when(n >= 2, profile.multi_token + F.least(profile.multi_step * (n - 2), F.lit(profile.multi_most))),
        "zero_cover": when(n == 0, profile.zero_cover),
    }
    if owners:
        out["help_owner"] = when(F.col("owner_hit"), profile.help_owner)
    if lanes:
        out["lane"] = F.when(root & F.col("lane").isin(*NAMED_LANES), profile.named_lane).when(root & (F.col("lane") == STEM_LANE), profile.stem_lane).otherwise(0.0)
    if howto:
        tokens = content_tokens(query)
        hay = text.fold(F.concat_ws(" ", "name", "synonym", "comment", "path"))
        weak = reduce(lambda a, b: a | b, (hay.contains(t) for t in tokens if t in profile.weak_words), F.lit(False))
        out["weak_singleton"] = when((n == 1) & weak & ~spared, profile.weak_singleton)
        out["rich_singleton"] = when(F.lit(total >= profile.rich_from) & (n == 1) & ~spared, profile.rich_singleton)
        out["camel_tail"] = when((n >= 1) & _unmatched_tail(tokens) & ~spared, profile.camel_tail)
    for rule in profile.rules:
        if (rule.query and not re.search(rule.query, query, re.IGNORECASE)) or total < rule.tokens_from:
            continue
        holds = F.lit(True)
        if rule.kinds:
            holds &= F.col("kind").isin(*rule.kinds)
        if rule.name_like:
            holds &= F.col("name").rlike(rule.name_like)
        if rule.path_like:
            holds &= F.col("path").rlike(rule.path_like)
        if rule.roots_only:
            holds &= root
        if rule.nested_only:
            holds &= ~root
        if rule.no_cover:
            holds &= n == 0
        if rule.covers:
            holds &= n.between(*rule.covers)
        if rule.unless_lane:
            holds &= ~spared
        out[rule.name] = when(holds, rule.weight)
        for term, most in rule.caps.items():
            out[term] = F.when(holds, F.least(out[term], F.lit(float(most)))).otherwise(out[term])
    return out


def _with_best(hits: DataFrame, bests: dict[str, Column]) -> DataFrame:
    """Add maxima over all hits: one aggregated row, broadcast, so hits stay in their tasks."""
    one = hits.agg(*(F.max(c).alias(name) for name, c in bests.items())).withColumn("_all", F.lit(1))
    return hits.withColumn("_all", F.lit(1)).join(F.broadcast(one), "_all").drop("_all")


def rerank(hits: DataFrame, query: str, profile: RankProfile | None = None, explain: bool = False, help_owners: bool = False) -> DataFrame:
    """Hits (path, kind, name, synonym, comment, raw_score and, from lanes, lane) with adjusted scores.

    Raw scores count by their share of the best. Where hits have an extension
    flag, extensions that are not clearly better than the best configuration
    hit are penalised. With help_owners, objects to which a help page among
    the hits belongs gain.
    """
    profile = profile or RankProfile()
    if help_owners:
        parts = F.split("path", r"\.")
        owners = hits.where("kind = 'Help'").select(F.concat_ws(".", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))).alias("path")).distinct()
        hits = hits.join(owners.withColumn("owner_hit", F.lit(True)), "path", "left").withColumn("owner_hit", F.coalesce("owner_hit", F.lit(False)))
    terms = features(query, profile, "lane" in hits.columns, help_owners)
    bests = {"_best": F.col("raw_score")}
    if "extension" in hits.columns:
        bests["_own"] = F.when(~F.col("extension"), F.col("raw_score"))
    pool = _with_best(hits, bests)
    terms["raw"] = F.when(F.col("_best") > 0, F.col("raw_score") / F.col("_best")).otherwise(0.0)
    if "extension" in hits.columns:
        terms["extension"] = F.when(F.col("extension") & (F.col("_own").isNull() | (F.col("raw_score") <= profile.extension_margin * F.col("_own"))), profile.extension_penalty).otherwise(0.0)
    out = pool.select(*hits.columns, *(c.cast("double").alias(f"f_{n}") for n, c in terms.items()))
    out = out.withColumn("score", reduce(lambda a, b: a + b, (F.col(f"f_{n}") for n in terms))).drop("owner_hit")
    return out if explain else out.drop(*(f"f_{n}" for n in terms))
