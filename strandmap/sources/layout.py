"""What a file of an export is, and to which object it belongs, from its path alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmap.sources.xml_objects import HEADS

# Folders of an export, by object element, where they are no plain plural.
_FOLDERS = {"DataProcessor": "DataProcessors", "ChartOfAccounts": "ChartsOfAccounts", "ChartOfCharacteristicTypes": "ChartsOfCharacteristicTypes", "ChartOfCalculationTypes": "ChartsOfCalculationTypes", "BusinessProcess": "BusinessProcesses", "SettingsStorage": "SettingsStorages", "ExchangePlan": "ExchangePlans"}
FOLDERS = {_FOLDERS.get(kind, kind[:-1] + "ies" if kind.endswith("y") else kind + "s"): head for kind, head in HEADS.items()}


def file_class(rel: Column) -> Column:
    """form, template, help, module, binary_form, object, info or other."""
    return (
        F.when(rel.rlike(r"(^|/)ConfigDumpInfo\.xml$"), "info")
        .when(rel.rlike(r"/Help/[^/]+\.html$"), "help")
        .when(rel.rlike(r"/Ext/Form\.xml$"), "form")
        .when(rel.rlike(r"/Ext/Form\.bin$"), "binary_form")
        .when(rel.rlike(r"/Ext/Template\.(xml|bin|txt)$"), "template")
        .when(rel.endswith(".bsl"), "module")
        .when(rel.rlike(r"^[^/]+/[^/]+\.xml$") | (rel == "Configuration.xml"), "object")
        .otherwise("other")
    )


def owner_path(rel: Column) -> Column:
    """Path of the object that a file describes: Head.Name, or with the form or template it belongs to; empty if unknown."""
    parts = F.split(rel, "/")
    head = F.try_element_at(F.create_map(*(F.lit(x) for kv in FOLDERS.items() for x in kv)), parts[0])
    name = F.regexp_replace(F.get(parts, F.lit(1)), r"\.xml$", "")
    inner = F.get(parts, F.lit(2))
    segment = F.when(inner == "Forms", "Формы").when(inner == "Templates", "Макеты").when(inner == "Commands", "Команды")
    tail = F.when(segment.isNotNull(), F.concat(F.lit("."), segment, F.lit("."), F.regexp_replace(F.get(parts, F.lit(3)), r"\.xml$", ""))).otherwise("")
    return F.coalesce(F.concat(head, F.lit("."), name, tail), F.lit(""))


def without_own_file(listed: DataFrame, objects: DataFrame) -> DataFrame:
    """Names listed in the export's index (column path) that no file describes."""
    return listed.join(objects.select("path"), "path", "left_anti")


def configuration(elements: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """(source_rel, name, synonym, version, is_extension) of the root element Configuration; one row.

    Where the file names no configuration, the elements of the export's index
    (``info``) do: the entry Configuration.<name>.
    """
    text = lambda tag: F.coalesce(F.max(F.when((F.col("tag") == tag) & (F.col("parent_tag") == "Properties"), F.col("text"))), F.lit(""))
    purpose = F.max((F.col("tag").isin("ConfigurationExtensionPurpose", "ObjectBelonging") & (F.col("text") != "")).cast("int")) == 1
    found = elements.where(F.col("error").isNull()).groupBy("source_rel").agg(text("Name").alias("name"), F.coalesce(F.min_by("text", F.when(F.col("tag") == "content", F.col("id"))), F.lit("")).alias("synonym"), text("Version").alias("version"), purpose.alias("is_extension"))
    if info is None:
        return found
    entry = F.try_element_at("attributes", F.lit("name"))
    listed = info.where(entry.rlike(r"^Configuration\.[^.]+$")).agg(F.min(F.substring(entry, 15, 1000)).alias("_listed")).withColumn("_all", F.lit(1))
    both = found.withColumn("_all", F.lit(1)).join(F.broadcast(listed), "_all", "left")  # one row on each side
    return both.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "_listed", F.lit(""))).drop("_all", "_listed")


def export_root(rels: DataFrame) -> str:
    """Folder of an export below an unpacked tree (column source_rel): the tree itself, or its only folder with a Configuration.xml; raises for none or several."""
    tops = rels.where(F.col("source_rel").rlike(r"^([^/]+/)?Configuration\.xml$")).select(F.regexp_extract("source_rel", "^(?:([^/]+)/)?", 1).alias("top")).distinct().limit(3).collect()
    found = sorted(r.top for r in tops)
    if "" in found:
        return ""
    if len(found) != 1:
        raise ValueError("no export found" if not found else f"several exports: {', '.join(found)}")
    return found[0]


def report_file(names: DataFrame) -> DataFrame:
    """The one report file of a folder: a name with 'report' or 'отчет' first, else a file that stands alone."""
    score = F.when(F.lower("name").rlike("report|отчет"), 1).otherwise(0)
    scored = names.where(F.lower("name").endswith(".txt")).withColumn("score", score)
    best = scored.orderBy(F.desc("score"), "name").limit(2).collect()  # two rows at most
    alone = len(best) == 1 or (best and best[0].score > best[1].score)
    return scored.where(F.col("name") == best[0].name).drop("score") if best and alone else scored.limit(0).drop("score")
