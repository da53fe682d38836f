"""Structure reports: text files of node lines, properties and quoted lists."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmap.functions import paths
from strandmap.operators.relations import fill_forward
from strandmap.session import ship

# Report keys whose values are links, and their link types.
LINK_KEYS = {"Тип": "type", "Движения": "movements", "ВводитсяНаОсновании": "based_on", "Состав": "composition"}


def decode(raw: bytes) -> tuple[str, str, int]:
    """(text, encoding, replaced characters): by BOM, else UTF-8 where the start is valid, else cp1251."""
    for bom, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if raw.startswith(bom):
            text = raw[len(bom) :].decode(name, "replace")
            return text, name, text.count("�")
    try:
        codecs.getincrementaldecoder("utf-8")().decode(raw[:8192])
        name = "utf-8"
    except UnicodeDecodeError:
        name = "cp1251"
    text = raw.decode(name, "replace")
    return text, name, text.count("�")


@F.pandas_udf(T.StructType().add("text", "string").add("encoding", "string").add("replaced", "integer"))
def decoded(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode(bytes(r or b"")) for r in raw], columns=["text", "encoding", "replaced"])


def read_lines(files: DataFrame) -> DataFrame:
    """(source_rel, line, value) of files (source_rel, content); spark.read.text knows no cp1251."""
    ship(files.sparkSession)
    text = files.select("source_rel", decoded("content").alias("d")).select("source_rel", F.col("d.text").alias("text"))
    return text.select("source_rel", F.posexplode(F.split("text", r"\r?\n")).alias("line", "value"))


def parse_nodes(lines: DataFrame) -> DataFrame:
    """(source_rel, path, line, key, values) of each property, and one row with a null key for each node.

    A node line closes the node before it; an empty value opens a list; quoted
    lines belong to the list opened last in the node; what stands before the
    first node is left out. The running node and list are filled forward piece
    by piece, so even one huge report is many tasks and nothing loops in Python.
    """
    v = F.col("value")
    node = F.regexp_extract(v, r"^\t*- (.+?)\s*$", 1)
    item = F.regexp_extract(v, r'^\s*"(.*)"\s*$', 1)
    key = F.regexp_extract(v, r'^\s*([^:"\-][^:"]*):\s*(.*)$', 1)
    rest = F.trim(F.regexp_extract(v, r'^\s*([^:"\-][^:"]*):\s*(.*)$', 2))
    marked = lines.where(F.trim(v) != "").select("source_rel", "line", node.alias("node"), v.rlike(r'^\s*".*"\s*$').alias("is_item"), item.alias("item"), F.trim(key).alias("key"), rest.alias("rest"))
    is_node, is_key = F.col("node") != "", (F.col("node") == "") & ~F.col("is_item") & (F.col("key") != "")
    current = F.when(is_node, F.struct("line", "node"))
    opened = F.when(is_node | is_key, F.struct("line", F.when(is_key & (F.col("rest") == ""), F.col("key")).alias("key")))
    rows = fill_forward(marked, ["source_rel"], "line", {"n": current, "o": opened}).where(F.col("n").isNotNull())
    nodes = rows.where(is_node).select("source_rel", F.col("node").alias("path"), F.col("line").alias("node_line"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("value"))
    scalars = rows.where(is_key & (F.col("rest") != "")).select("source_rel", F.col("n.node").alias("path"), F.col("n.line").alias("node_line"), "key", "line", F.regexp_replace("rest", '^"(.*)"$', "$1").alias("value"))
    empties = rows.where(is_key & (F.col("rest") == "")).select("source_rel", F.col("n.node").alias("path"), F.col("n.line").alias("node_line"), "key", "line", F.lit(None).cast("string").alias("value"))
    items = rows.where(F.col("is_item") & F.col("o.key").isNotNull()).select("source_rel", F.col("n.node").alias("path"), F.col("n.line").alias("node_line"), F.col("o.key").alias("key"), "line", F.col("item").alias("value"))
    both = nodes.unionByName(scalars).unionByName(empties).unionByName(items)
    return both.groupBy("source_rel", "path", "node_line", "key").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("line", "value")))), lambda s: s["value"]).alias("values"))


def report_objects(parsed: DataFrame) -> DataFrame:
    """(path, kind, name, synonym, comment, props); of repeated paths the last counts; the kind follows from the last container."""
    props = parsed.where(F.col("key").isNotNull()).groupBy("source_rel", "path", "node_line").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("props"))
    nodes = parsed.where(F.col("key").isNull()).select("source_rel", "path", "node_line").join(props.hint("merge"), ["source_rel", "path", "node_line"], "left")
    last = nodes.groupBy("path").agg(F.max_by(F.struct("props", "source_rel"), F.struct("source_rel", "node_line")).alias("n"))
    first = lambda key: F.coalesce(F.get(F.try_element_at(F.col("props"), F.lit(key)), F.lit(0)), F.lit(""))
    out = last.select("path", F.col("n.props").alias("props"), F.col("n.source_rel").alias("source_rel"))
    parts = F.split("path", r"\.")
    kind = F.element_at(parts, F.when(F.size(parts) >= 2, -2).otherwise(-1))
    return out.select("path", kind.alias("kind"), F.coalesce(F.nullif(first("Имя"), F.lit("")), paths.leaf(F.col("path"))).alias("name"), first("Синоним").alias("synonym"), first("Комментарий").alias("comment"), "source_rel", "props")


def report_links(parsed: DataFrame) -> DataFrame:
    """(from_path, to_ref, link_type) of the link keys."""
    kinds = F.create_map(*(F.lit(x) for kv in LINK_KEYS.items() for x in kv))
    rows = parsed.where(F.col("key").isin(*LINK_KEYS))
    return rows.select(F.col("path").alias("from_path"), F.explode("values").alias("to_ref"), kinds[F.col("key")].alias("link_type")).distinct()


def read_reports(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return read_lines(files.select(F.col("path").alias("source_rel"), "content"))
