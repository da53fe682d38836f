"""Help pages: sections of HTML as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain(html: Column) -> Column:
    """Text of a piece of HTML: tags as spaces, the usual entities resolved, white space made single."""
    out = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in _ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    # A single space is no match, as most white space is one.
    return F.trim(F.regexp_replace(out, r"\s{2,}|[^\S ]", " "))


def visible(html: Column) -> Column:
    """HTML without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)", "")


def split_long(body: Column, most: int = 2600) -> Column:
    """Sentences (cut after '. ') packed greedily into pieces of ``most`` characters; a longer sentence stands alone."""
    none = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("length"), F.lit(1).alias("at"))

    def pack(done: Column, s: Column) -> Column:
        """Where pieces start; the sentences of one are joined when all places are known."""
        long = done["length"] + 1 + F.length(s)
        fits = (done["at"] > 1) & (long <= most)
        starts = F.when(fits, done["starts"]).otherwise(F.array_append(done["starts"], done["at"]))
        return F.struct(starts.alias("starts"), F.when(fits, long).otherwise(F.length(s)).alias("length"), (done["at"] + 1).alias("at"))

    def pieces(done: Column) -> Column:
        stop = lambda i: F.coalesce(F.get(done["starts"], i + 1), done["at"])
        return F.transform(done["starts"], lambda start, i: F.struct(start.alias("start"), (stop(i) - start).alias("n")))

    def joined(sentences: Column) -> Column:
        return F.transform(F.aggregate(sentences, none, pack, pieces), lambda p: F.array_join(F.slice(sentences, p["start"], p["n"]), " "))

    # An array of one names the sentences, so that they are cut once.
    return F.when(F.length(body) <= most, F.array(body)).otherwise(F.get(F.transform(F.array(F.split(body, r"(?<=\.) ")), joined), F.lit(0)))


def sections(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, ord, heading, body): text before the first heading, then one row for each of h1 to h3; h4 stays inside.

    Sections without a heading and a body are left out, before they are rows: a filter on rows would make both anew.
    """
    parts = F.split(visible(F.col(html)), r"(?i)<h[1-3]\b[^>]*>", -1)
    closing = lambda part, i: F.when(i > 0, F.regexp_instr(part, F.lit(r"(?i)</h[1-3]>"))).otherwise(0)
    marked = F.transform(parts, lambda part, i: F.struct(i.alias("ord"), part.alias("part"), closing(part, i).alias("closing")))

    def section(m: Column) -> Column:
        part, at = m["part"], m["closing"]
        heading = F.when(at > 0, plain(F.substring(part, F.lit(1), at - 1))).otherwise("")
        return F.struct(m["ord"].alias("ord"), heading.alias("heading"), plain(F.when(at > 0, F.substring(part, at + 5, F.length(part))).otherwise(part)).alias("body"))

    return pages.select(key, F.inline(F.filter(F.transform(marked, section), lambda s: (s["heading"] != "") | (s["body"] != ""))))


def passages(pages: DataFrame, key: str, owner: str, html: str = "html", most: int = 2600) -> DataFrame:
    """(key, path, heading, body): Help.<owner> for the first piece, Help.<owner>.<i> for the others; a key has one owner."""
    found = sections(pages.select(F.struct(key, owner).alias("_page"), html), "_page", html).where("body <> ''")
    each = found.select("_page", "ord", "heading", F.posexplode(split_long(F.col("body"), most)).alias("piece", "body"))
    ordered = each.groupBy("_page").agg(F.array_sort(F.collect_list(F.struct("ord", "piece", "heading", "body"))).alias("all"))
    rows = ordered.select("_page", F.posexplode("all").alias("i", "s"))
    suffix = F.when(F.col("i") == 0, "").otherwise(F.concat(F.lit("."), F.col("i").cast("string")))
    return rows.select(F.col("_page")[key].alias(key), F.concat(F.lit("Help."), F.col("_page")[owner], suffix).alias("path"), F.col("s.heading").alias("heading"), F.col("s.body").alias("body"))
