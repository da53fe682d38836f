"""Source modules: procedures, functions, regions, exports and calls, by functions over a file's lines.

A string that runs over lines is continued by lines that start with a bar, so
every line can be masked on its own, and nesting is a running count: no parser
state has to be carried in Python. A file is cut into its methods where it is
read, so texts are neither shuffled nor sorted; regions go by windows over the
few lines that open, close or need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.operators.relations import fill_forward
from strandmap.operators.scans import running_sums
from strandmap.session import cut

# Keywords in both languages.
BEGIN = r"(?iu)^\s*(?:Асинх\s+|Async\s+)?(Процедура|Функция|Procedure|Function)\s+([\p{L}_][\p{L}\p{N}_]*)\s*\("
END = r"(?iu)^\s*(?:КонецПроцедуры|КонецФункции|EndProcedure|EndFunction)(?![\p{L}\p{N}_])"
EXPORT = r"(?iu)\)\s*(?:Экспорт|Export)(?![\p{L}\p{N}_])"
REGION = r"(?iu)^\s*#\s*(?:Область|Region)\s+([\p{L}\p{N}_]+)"
END_REGION = r"(?iu)^\s*#\s*(?:КонецОбласти|EndRegion)"
#: A name begins where no letter precedes it; possessive, as what it runs over can't begin another.
CALL = r"(?<![\p{L}_])([\p{L}_][\p{L}\p{N}_]*+)\s*+\("

#: Headers of methods in files with regions whose regions are broadcast at most.
BROADCAST_HEADERS = 200_000


def mask(line: Column) -> Column:
    """A line without string contents and comments; also those of strings continued from the line before."""
    plain = ~(line.contains('"') | line.contains("|") | line.contains("//"))
    continued = F.regexp_replace(line, r'^\s*\|(?:[^"]|"")*("|$)', '""')
    strings = F.regexp_replace(continued, r'"(?:[^"]|"")*("|$)', '""')
    return F.when(plain, line).otherwise(F.regexp_replace(strings, r"//.*$", ""))


def lines_of(modules: DataFrame) -> DataFrame:
    """(source_rel, parent_path, module_role, text, lines) of modules (source_rel, parent_path, module_role, text)."""
    return modules.select("source_rel", "parent_path", "module_role", "text", F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n").alias("lines"))


def regions(files: DataFrame, piece: int = 50_000) -> DataFrame:
    """(source_rel, line, region (name, at)) of the headers of methods that lie in a region: the innermost open one.

    Only lines that open or close a region or begin a method count, and are
    computed once; depths and names go by pieces of a file's lines.
    """
    code = F.col("code")
    opens, closes = code.rlike(REGION), code.rlike(END_REGION)
    lines = files.where(F.col("text").contains("#")).select("source_rel", F.posexplode("lines").alias("at", "raw")).where(F.col("raw").contains("#") | F.col("raw").contains("("))
    marks = lines.select("source_rel", (F.col("at") + 1).alias("line"), mask(F.col("raw")).alias("code")).where(opens | closes | code.rlike(BEGIN))
    name = F.when(opens, F.struct(F.regexp_extract(code, REGION, 1).alias("name"), F.col("line").alias("at")))
    marks = cut(marks.select("source_rel", "line", F.when(opens, 1).when(closes, -1).otherwise(0).alias("step"), name.alias("opened")))
    deep = running_sums(marks, ["source_rel"], "line", {"depth": F.col("step")}, floored=["depth"], piece=piece).where("depth > 0")
    # Among lines of one depth the last that was opened is the one that is open: a deeper one has another depth.
    filled = fill_forward(deep, ["source_rel", "depth"], "line", {"region": F.col("opened")}, piece=piece)
    found = filled.where("step = 0").select("source_rel", "line", "region").dropDuplicates(["source_rel", "line"])  # a file may be told twice
    return F.broadcast(found) if marks.where("step = 0").count() <= BROADCAST_HEADERS else found


def methods(files: DataFrame, piece: int = 50_000) -> DataFrame:
    """One row a method of modules with their lines: path, kind, export, signature, doc comment, body, region, line, calls.

    A method runs from its header to its end keyword, to the next header where
    that is missing, or to the end of the file. The header goes on until its
    parentheses close. The doc comment is the run of comment lines right above,
    annotations between them left out. The region is the innermost open one: the last opened
    among lines of the same depth. Ends of regions that no region precedes count
    for nothing, and a region that is left open lasts to the end of the file.
    Depths go by pieces of so many lines; a file is one row, as it is read.
    """
    begins = F.array_compact(F.transform("lines", lambda x, i: F.when(x.contains("(") & mask(x).rlike(BEGIN), i + 1)))
    at = files.select("source_rel", "parent_path", "module_role", "lines", begins.alias("begins"))

    def method(line: Column, i: Column) -> Column:
        """The lines of a method up to the next header, and the comment above it."""
        before, after = F.coalesce(F.get("begins", i - 1), F.lit(0)), F.coalesce(F.get("begins", i + 1), F.size("lines") + 1)
        return F.struct(line.alias("line"), F.slice("lines", line, after - line).alias("raw"), _comment(F.slice("lines", before + 1, line - before - 1)).alias("comment"))

    each = at.select("source_rel", "parent_path", "module_role", F.explode(F.transform("begins", method)).alias("m")).select("source_rel", "parent_path", "module_role", "m.*")
    each = each.withColumn("code", F.transform("raw", mask)).withColumn("end", F.array_position(F.transform("code", lambda x: x.rlike(END)), True).cast("int"))
    each = each.withColumn("n", F.when(F.col("end") > 0, F.col("end")).otherwise(F.size("raw"))).withColumn("closed", _closed(F.col("code")))
    each = each.withColumn("head", F.when(F.col("closed").between(1, F.col("n")), F.col("closed")).otherwise(F.col("n")))
    # The line of the end keyword is no part of the body.
    rest = F.greatest(F.lit(0), F.col("n") - F.col("head") - (F.col("end") > 0).cast("int"))
    text = lambda c, start, size: F.array_join(F.slice(c, start, size), "\n")
    out = each.select(
        "source_rel", "parent_path", "module_role", "line", "comment", (F.col("line") + F.col("n") - 1).alias("end_line"), text("raw", F.lit(1), F.col("head")).alias("signature"), text("code", F.lit(1), F.col("head")).alias("header"),
        text("raw", F.col("head") + 1, rest).alias("body"), text("code", F.col("head") + 1, rest).alias("masked"),
    ).join(regions(files, piece), ["source_rel", "line"], "left")
    name = F.regexp_extract("header", BEGIN, 2)
    word = F.lower(F.regexp_extract("header", BEGIN, 1))
    calls = F.when(F.col("masked").contains("("), F.array_sort(F.array_distinct(F.regexp_extract_all("masked", F.lit(CALL), 1)))).otherwise(F.array().cast("array<string>"))
    return out.select(
        "source_rel", F.concat("parent_path", F.lit(".Методы."), "module_role", F.lit("."), name).alias("path"), "parent_path", "module_role", name.alias("name"),
        F.when(word.isin("функция", "function"), "Function").otherwise("Procedure").alias("kind"), F.col("header").rlike(EXPORT).alias("export"),
        F.trim(F.regexp_replace("signature", r"\s+", " ")).alias("signature"), "comment", "body",
        F.coalesce("region.name", F.lit("")).alias("region"), F.col("region.at").alias("region_line"), "line", "end_line", calls.alias("calls"),
    )


def _comment(above: Column) -> Column:
    """The comment lines at the end of these lines; a run is broken by lines that are neither comments, annotations nor blank."""
    remark = lambda x: F.trim(x).startswith("//")
    breaks = lambda x: ~(remark(x) | F.trim(x).startswith("&") | (F.trim(x) == ""))
    last = F.coalesce(F.array_max(F.transform(above, lambda x, i: F.when(breaks(x), i + 1))), F.lit(0))
    return F.array_join(F.transform(F.filter(F.slice(above, last + 1, F.size(above)), remark), lambda x: F.regexp_replace(F.trim(x), r"^//\s?", "")), "\n")


def _closed(code: Column) -> Column:
    """The first line after which as many parentheses are closed as opened; 0 if there is none."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))

    def step(done: Column, x: Column) -> Column:
        balance = done["balance"] + count(x, "(") - count(x, ")")
        return F.when(done["found"] > 0, done).otherwise(F.struct((done["at"] + 1).alias("at"), balance.alias("balance"), F.when(balance <= 0, done["at"] + 1).otherwise(0).alias("found")))

    none = F.struct(F.lit(0).alias("at"), F.lit(0).alias("balance"), F.lit(0).alias("found"))
    return F.aggregate(code, none, step, lambda done: done["found"])


def role_of(rel: Column) -> Column:
    """The role of a module by its file name."""
    file = F.substring_index(rel, "/", -1)
    role = F.lit("Module")
    for name in ("ObjectModule", "ManagerModule", "RecordSetModule", "CommandModule", "ValueManagerModule"):
        role = F.when(file == f"{name}.bsl", name).otherwise(role)
    return F.when(rel.contains("/Forms/"), "FormModule").otherwise(role)


def region_counts(found: DataFrame) -> DataFrame:
    """(source_rel, region, n, exports) of methods."""
    return found.groupBy("source_rel", "region").agg(F.count("*").alias("n"), F.count_if("export").alias("exports"))


def pending_calls(found: DataFrame) -> DataFrame:
    """(caller, callee_name) of each distinct call."""
    return found.select(F.col("path").alias("caller"), F.explode("calls").alias("callee_name")).distinct()


def body_from(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Methods (source_rel, name, line) with the body that their module's text (source_rel, text) holds now.

    The header with the name that is nearest to the stored line counts, as edits
    above it move it; the body runs to the line before the next header or end.
    """
    lines = texts.select("source_rel", F.posexplode(F.split("text", r"\r?\n")).alias("at", "raw")).withColumn("code", mask(F.col("raw")))
    headers = lines.where(F.col("code").rlike(BEGIN)).select("source_rel", (F.col("at") + 1).alias("begin"), F.lower(F.regexp_extract("code", BEGIN, 2)).alias("_name"))
    wanted = found.select("source_rel", "name", "line", F.lower("name").alias("_name"))
    near = wanted.join(headers, ["source_rel", "_name"]).groupBy("source_rel", "name", "line").agg(F.min_by("begin", F.struct(F.abs(F.col("begin") - F.col("line")), F.col("begin"))).alias("begin"))
    ends = lines.where(F.col("code").rlike(END) | F.col("code").rlike(BEGIN)).select("source_rel", (F.col("at") + 1).alias("stop"))
    closed = near.join(ends, "source_rel", "left").groupBy("source_rel", "name", "line", "begin").agg(F.min(F.when(F.col("stop") > F.col("begin"), F.col("stop"))).alias("stop"))
    inside = closed.join(lines, "source_rel").where((F.col("at") + 1 > F.col("begin")) & (F.col("stop").isNull() | (F.col("at") + 1 < F.col("stop"))))
    bodies = inside.groupBy("source_rel", "name", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda s: s["raw"]), "\n").alias("body"))
    return closed.select("source_rel", "name", "line", F.col("begin").alias("found_at")).join(bodies, ["source_rel", "name", "line"], "left").withColumn("body", F.coalesce("body", F.lit("")))
