"""Path and name lookups over objects: ranges, exact names, prefixes, stems, tokens."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandmap.functions import paths, text
from strandmap.plans.substring_index import SubstringIndex
from strandmap.sources.xml_objects import HEADS


def filter_objects(objects: DataFrame, kind: str | None = None, prefix: str | None = None, without_methods: bool = False, methods_only: bool = False, own_only: bool = False) -> DataFrame:
    """Filters joined by AND; each is pushed to the scan."""
    if kind is not None:
        objects = objects.where(F.col("kind") == kind)
    if prefix is not None:
        objects = objects.where(paths.strictly_under(F.col("path"), prefix))
    if without_methods:
        objects = objects.where(~F.col("kind").isin("Procedure", "Function"))
    if methods_only:
        objects = objects.where(F.col("kind").isin("Procedure", "Function"))
    if own_only:
        objects = objects.where(F.col("belong") == "Own")
    return objects


def name_variants(name: str) -> list[str]:
    """A requested name in four cases, and its words run together, as names of objects are written."""
    words = [w for w in re.split(r"[\s_-]+", name) if w]
    compact = ["".join(words), "".join(w[:1].upper() + w[1:] for w in words)] if len(words) > 1 else []
    return list(dict.fromkeys([name, name.lower(), name.upper(), name[:1].upper() + name[1:], *compact]))


def _requests(spark: SparkSession, names: list[str]) -> DataFrame:
    rows = [(v, i) for i, n in enumerate(names) for v in name_variants(n)]
    return F.broadcast(spark.createDataFrame(rows or [("", -1)], "name string, ordinal int").groupBy("name").agg(F.min("ordinal").alias("ordinal")))  # a request's few names


def by_paths(objects: DataFrame, wanted: list[str]) -> DataFrame:
    """Objects of the given paths; a short list becomes a pushed-down filter."""
    return objects.where(F.col("path").isin(wanted))


def write_names(objects: DataFrame, path: str) -> None:
    """Store objects once more, sorted by their folded names (column folded), so that lookups by name skip files and row groups."""
    rows = objects.withColumn("folded", text.fold(F.col("name")))
    # The path parts names that many objects have.
    rows.repartitionByRange("folded", "path").sortWithinPartitions("folded", "path").write.parquet(path)


def named(objects: DataFrame, names: list[str]) -> DataFrame:
    """Objects with one of some names; frames of ``write_names`` are pruned by the folded ones."""
    if "folded" in objects.columns:
        objects = objects.where(F.col("folded").isin(sorted({n.lower().replace("ё", "е") for n in names}))).drop("folded")
    return objects.where(F.col("name").isin(names))


def exact_names(objects: DataFrame, names: list[str], prefix: str | None = None) -> DataFrame:
    """Objects named as requested, in the variants of ``name_variants``, with the ordinal of the request; names are pushed to the scan."""
    wanted = list(dict.fromkeys(v for n in names for v in name_variants(n)))
    found = filter_objects(named(objects, wanted), prefix=prefix).join(_requests(objects.sparkSession, names), "name")
    best = Window.partitionBy("path").orderBy("ordinal")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def name_prefixes(objects: DataFrame, stems: list[str], prefix: str, most: int = 12) -> DataFrame:
    """Roots below ``prefix`` whose names start with a stem of five letters or more, ``most`` a stem by path."""
    stems = [s[:1].upper() + s[1:] for s in stems if len(s) >= 5]
    stem = F.coalesce(*(F.when(F.col("name").startswith(s), F.lit(s)) for s in stems)) if stems else F.lit(None).cast("string")
    roots = filter_objects(objects, prefix=prefix).where(paths.is_root(F.col("path"))).withColumn("stem", stem).where(F.col("stem").isNotNull())
    return roots.withColumn("n", F.row_number().over(Window.partitionBy("stem").orderBy("path"))).where(F.col("n") <= most)


def stem_roots(objects: DataFrame, stem: str, prefix: str, no_middle: tuple[str, ...] = ()) -> DataFrame:
    """Roots by name prefix; only if there are none, by a stem of eight letters or more anywhere in the name."""
    roots = filter_objects(objects, prefix=prefix).where(paths.is_root(F.col("path")))
    starts = roots.where(F.startswith(F.lower("name"), F.lit(stem.lower())))
    if len(stem) < 8 or prefix in no_middle:
        return starts.withColumn("stage", F.lit(0))
    if not starts.isEmpty():
        return starts.withColumn("stage", F.lit(0))
    return roots.where(F.lower("name").contains(stem.lower())).withColumn("stage", F.lit(1))


def haystack(fields: tuple[str, ...] = ("name", "comment", "path")) -> Column:
    """Folded fields, a line each."""
    return text.fold(F.concat_ws("\n", *fields))


def token_search(objects: DataFrame | SubstringIndex, tokens: list[str], fields: tuple[str, ...] = ("name", "comment", "path"), prefix: str | None = None) -> DataFrame:
    """Objects in which every token, or its stem, occurs in some field; an index of ``haystack(fields)`` reads candidates only."""
    if isinstance(objects, SubstringIndex):  # a stem begins its token, so what holds either holds the stem
        objects = objects.likely([t.lower()[: max(6, len(t) - 2)] for t in tokens])
    return filter_objects(objects, prefix=prefix).where(has_tokens(tokens, fields))


def has_tokens(tokens: list[str], fields: tuple[str, ...] = ("name", "comment", "path")) -> Column:
    hay = haystack(fields)
    hit = lambda t: hay.contains(t.lower()) | hay.contains(t.lower()[: max(6, len(t) - 2)])
    return reduce(lambda a, b: a & b, map(hit, tokens), F.lit(True))


def any_token(objects: DataFrame, tokens: list[str], fields: tuple[str, ...] = ("name", "comment", "path")) -> DataFrame:
    """Objects with some token, with the number of tokens they hold."""
    hay = haystack(fields)
    n = reduce(lambda a, b: a + b, (hay.contains(t.lower()).cast("int") for t in tokens), F.lit(0))
    return objects.withColumn("n_tokens", n).where("n_tokens > 0")


def token_score(tokens: list[str]) -> Column:
    """1, and for each token: its name 8, in the name 4, in the comment 3, in the path 1, anywhere 0.5; again for its stem without the 8."""
    name, comment, path = (text.fold(F.col(c)) for c in ("name", "comment", "path"))
    score = F.lit(1.0)
    for t in (t.lower() for t in tokens):
        stem = t[: max(6, len(t) - 2)]
        score = score + F.when(name == t, 8.0).otherwise(0.0)
        for part in [t] + [stem] * (stem != t):
            score = score + F.when(name.contains(part), 4.0).otherwise(0.0) + F.when(comment.contains(part), 3.0).otherwise(0.0) + F.when(path.contains(part), 1.0).otherwise(0.0)
            score = score + F.when(name.contains(part) | comment.contains(part) | path.contains(part), 0.5).otherwise(0.0)
    return score


def identifier(objects: DataFrame, query: str, names: DataFrame | None = None) -> DataFrame:
    """Objects by path, else by name: stage 0 or 1, the better one alone for each path; with ``names`` (see ``write_names``) both lookups skip files."""
    if names is not None:
        by_path = objects.where(F.col("path") == query).withColumn("stage", F.lit(0))
        by_name = named(names, [query]).where(F.col("path") != query).withColumn("stage", F.lit(1))
        return by_path.unionByName(by_name.select(*by_path.columns))
    found = objects.where((F.col("path") == query) | (F.col("name") == query))
    return found.withColumn("stage", F.when(F.col("path") == query, 0).otherwise(1))


def titles(objects: DataFrame, kind: str, number: str) -> DataFrame:
    """Objects whose names end in a number: rank 0 with the separator # before it or none, 1 otherwise."""
    named = objects.where((F.col("kind") == kind) & F.col("name").endswith(number))
    return named.withColumn("rank", F.when(F.col("name").endswith("#" + number) | (F.col("name") == number), 0).otherwise(1))


def exists_under(objects: DataFrame, path: str) -> DataFrame:
    """One row: whether the path or something below it exists."""
    return objects.where(paths.under(F.col("path"), path)).limit(1).agg((F.count("*") > 0).alias("found"))


def without_excluded(objects: DataFrame, part: str) -> DataFrame:
    """Objects of which neither they nor an ancestor has ``part`` in its leaf name."""
    return objects.where(~F.exists(paths.ancestors(F.col("path")), lambda a: F.substring_index(a, ".", -1).contains(part)))


def exact_then_prefix(methods: DataFrame, name: str, most: int) -> DataFrame:
    """Names equal to the request, then names that start with it, ``most`` in all."""
    found = methods.where(F.startswith(F.lower("name"), F.lit(name.lower())))
    found = found.withColumn("stage", F.when(F.lower("name") == name.lower(), 0).otherwise(1))
    return found.orderBy("stage", "name", "path").limit(most)


def resolve_contexts(contexts: DataFrame, ref: str) -> DataFrame:
    """A context by its exact name, else the only enabled one whose name holds the reference; candidates otherwise."""
    enabled = contexts.where("enabled")
    exact = F.lower("name") == ref.lower()
    found = enabled.where(F.lower("name").contains(ref.lower())).withColumn("exact", exact)
    w = Window.partitionBy()  # the contexts are few
    found = found.withColumn("n_exact", F.sum(F.col("exact").cast("int")).over(w)).withColumn("n", F.count("*").over(w))
    status = F.when((F.col("n_exact") > 0) | (F.col("n") == 1), "resolved").otherwise("candidate")
    return found.where("exact or n_exact = 0").select("name", status.alias("status"))


#: Kinds of forms.
FORMS = ("Form", "ManagedForm", "CommonForm")


def containing(objects: DataFrame, needle: str, kinds: tuple[str, ...] = FORMS, fields: tuple[str, ...] = ("name", "path", "synonym", "comment"), prefix: str | None = None) -> DataFrame:
    """Objects of the kinds with the needle in some field, without regard to case; forms unless told otherwise."""
    hay = F.lower(F.concat_ws(" ", *(f for f in fields if f in objects.columns)))
    return filter_objects(objects, prefix=prefix).where(F.col("kind").isin(*kinds) & hay.contains(needle.lower()))


def report_scope(kind: str | None, prefix: str | None) -> tuple[str | None, str | None, bool]:
    """(kind, prefix, roots only) of a search: one for reports without a prefix looks below all reports and keeps their roots."""
    return (None, HEADS["Report"], True) if kind == "Report" and prefix is None else (kind, prefix, False)


def json_number(rows: DataFrame, column: str, field: str, least: float, alias: str) -> DataFrame:
    """Rows whose JSON column has a whole number of ``least`` or more in a field; broken JSON counts as none."""
    value = F.try_variant_get(F.try_parse_json(column), f"$.{field}", "bigint")
    return rows.withColumn(alias, value).where(F.col(alias) >= least)


def with_substring(rows: DataFrame | SubstringIndex, column: str, needle: str, alias: str = "place") -> DataFrame:
    """Rows that hold a needle, pushed to the scan, with its 1-based place; an index of the column reads candidates only."""
    rows = rows.likely([needle]) if isinstance(rows, SubstringIndex) else rows
    return rows.where(F.col(column).contains(needle)).withColumn(alias, F.instr(column, needle).cast("long"))


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(key), key, "left_anti")


def compact(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with blank strings of the given columns as null, others as they are."""
    return rows.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def in_request_order(rows: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows whose column is among the requested values, with the ordinal of the request."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col(column)) - 1
    return rows.where(F.col(column).isin(*wanted)).withColumn("ordinal", place.cast("int"))


def named_in(texts: DataFrame, key: str, column: str, names: DataFrame) -> DataFrame:
    """(key, name): the names (column name) that a text holds as a word, each once; an equi-join on words, never one on substrings."""
    words = texts.select(key, F.explode(F.array_distinct(text.tokens(F.col(column)))).alias("_word"))
    wanted = names.select("name", text.fold(F.col("name")).alias("_word")).distinct()
    return words.join(wanted, "_word").select(key, "name").distinct()
