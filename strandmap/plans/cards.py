"""Object cards: structure, dossier, comparison, required fields, code references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import paths, text
from strandmap.plans.substring_index import SubstringIndex

# Segments of child containers.
ATTRIBUTES, DIMENSIONS, RESOURCES, SECTIONS = "Реквизиты", "Измерения", "Ресурсы", "ТабличныеЧасти"


def structure(objects: DataFrame, path: str, most: int = 200) -> DataFrame:
    """(role, section, name, path) of an object's attributes, dimensions, resources, table sections and their columns.

    The role follows from the segments after the object's path alone; ``most``
    rows of a role, by path.
    """
    rel = F.split(paths.relative(F.col("path"), F.lit(path)), r"\.")
    n = F.size(rel)
    role = (
        F.when((n == 2) & (rel[0] == ATTRIBUTES), "attribute")
        .when((n == 2) & (rel[0] == DIMENSIONS), "dimension")
        .when((n == 2) & (rel[0] == RESOURCES), "resource")
        .when((n == 2) & (rel[0] == SECTIONS), "section")
        .when((n == 4) & (rel[0] == SECTIONS) & (F.get(rel, F.lit(2)) == ATTRIBUTES), "column")
    )
    rows = objects.where(paths.strictly_under(F.col("path"), path)).select("path", "name", role.alias("role"), F.when(F.col("path").contains(f".{SECTIONS}."), F.get(rel, F.lit(1))).otherwise("").alias("section"))
    w = Window.partitionBy("role").orderBy("path")
    return rows.where(F.col("role").isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n").select("role", "section", "name", "path")


def children(objects: DataFrame, parent: F.Column) -> DataFrame:
    """(owner, n_children, first, last) for every object with children, by the path's first two segments."""
    return objects.where(paths.depth(F.col("path")) > 1).groupBy(parent.alias("owner")).agg(F.count("*").alias("n_children"), F.min("path").alias("first"), F.max("path").alias("last"))


def dossier(objects: DataFrame, links: DataFrame, path: str) -> DataFrame:
    """(section, item, n): children by kind, outgoing and incoming links by type, of one object."""
    kids = objects.where(paths.strictly_under(F.col("path"), path)).groupBy(F.col("kind").alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("children"))
    out = links.where(paths.under(F.col("from_path"), path)).groupBy(F.col("link_type").alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("outgoing"))
    into = links.where(F.col("to_path") == path).groupBy(F.col("link_type").alias("item")).agg(F.count("*").alias("n")).withColumn("section", F.lit("incoming"))
    return kids.unionByName(out).unionByName(into).select("section", "item", "n")


def compare(items: DataFrame, left: str, right: str) -> DataFrame:
    """(role, name, place) of two objects' structure rows: only_a, only_b or both."""
    a = structure(items, left).select("role", "section", "name").distinct().withColumn("_a", F.lit(True))
    b = structure(items, right).select("role", "section", "name").distinct().withColumn("_b", F.lit(True))
    both = a.join(b, ["role", "section", "name"], "full_outer")
    return both.select("role", "section", "name", F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both").alias("place"))


def required_fields(objects: DataFrame, methods: DataFrame, path: str, words: list[str], adders: str, default: str = "DontCheck") -> DataFrame:
    """(source, name): fields checked for filling or called required in their comment, and names that code adds to a list of checks.

    adders is a regular expression whose first group is the added name.
    """
    under = objects.where(paths.strictly_under(F.col("path"), path))
    check = F.get(F.col("props")["FillChecking"], F.lit(0))
    declared = under.where(check.isNotNull() & (check != default)).select(F.lit("declared").alias("source"), "name")
    said = under.where(text.fold(F.col("comment")).rlike("|".join(words))).select(F.lit("comment").alias("source"), "name")
    added = methods.where(paths.strictly_under(F.col("path"), path)).select(F.lit("code").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(adders), 1))).alias("name"))
    return declared.unionByName(said).unionByName(added).distinct()


def references(texts: DataFrame | SubstringIndex, needle: str, key: str, text_col: str = "text") -> DataFrame:
    """(key, nth, line, snippet) of every match of a needle, without regard to case; matches do not overlap.

    Texts without the needle go before anything is split; an index of the texts
    reads candidates only.
    """
    texts = texts.likely([needle]) if isinstance(texts, SubstringIndex) else texts
    low = F.lower(text_col)
    found = texts.where(low.contains(needle.lower())).select(key, F.col(text_col).alias("_text"), F.split(low, f"\\Q{needle.lower()}\\E", -1).alias("_parts"))
    n, lines = len(needle), needle.count("\n")
    # One pass over the parts keeps the place and the line of each match; no text is cut or summed anew for each of them.
    breaks = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    start = F.struct(F.lit(1).alias("place"), F.lit(1).alias("line"), F.array().cast("array<struct<place:int,line:int>>").alias("out"))

    def walk(s, p):
        here = F.struct((s["place"] + F.length(p)).alias("place"), (s["line"] + breaks(p)).alias("line"))
        return F.struct((here["place"] + n).alias("place"), (here["line"] + lines).alias("line"), F.array_append(s["out"], here).alias("out"))

    places = F.aggregate(F.slice("_parts", F.lit(1), F.size("_parts") - 1), start, walk, lambda s: s["out"])
    each = found.select(key, "_text", F.posexplode(places).alias("nth", "at"))
    return each.select(key, (F.col("nth") + 1).alias("nth"), F.col("at.line").alias("line"), text.snippet(F.col("_text"), F.col("at.place"), n).alias("snippet"))


def enclosing(references: DataFrame, methods: DataFrame, by: str = "source_rel") -> DataFrame:
    """References with the method that encloses their line; those on a declaration line are left out."""
    from strandmap.operators.relations import as_of

    return as_of(references, methods.select(by, "line", "path"), [by], "line", "path")
