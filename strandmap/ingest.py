"""Incremental ingest: stamps, merge, sweep, orphans and calls, as joins of snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.functions import paths, text
from strandmap.limits import Limits
from strandmap.operators import relations
from strandmap.session import cut, ship
from strandmap.sources import layout, xml_objects


#: Characters of a method's signature and of a form's structure in a meta line at most.
SIGNATURE, STRUCTURE = 800, 1800


def stamps(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(rel_path, mtime, size) of the files below a folder; contents are not read."""
    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(paths.nfc(F.col("path")).alias("rel_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def compare_stamps(old: DataFrame, new: DataFrame, stamped: bool = False) -> DataFrame:
    """(rel_path, action): added, removed, parse or skip; ``stamped`` adds the new mtime and size. A full join, so added files are seen too."""
    both = old.toDF("rel_path", "_m", "_s").join(new.toDF("rel_path", "mtime", "size"), "rel_path", "full_outer")
    action = F.when(F.col("_m").isNull(), "added").when(F.col("mtime").isNull(), "removed").when((F.col("_m") == F.col("mtime")) & (F.col("_s") == F.col("size")), "skip").otherwise("parse")
    return both.select("rel_path", action.alias("action"), *(["mtime", "size"] if stamped else []))


def all_unchanged(actions: DataFrame) -> bool:
    return actions.where("action <> 'skip'").isEmpty()


#: What makes a difference to an object's content, in the order in which it is hashed.
HASHED = ("base_object", "belong", "comment", "kind", "name", "path", "props", "synonym")


def with_hash(objects: DataFrame) -> DataFrame:
    """Objects with the hash of all that makes a difference to their content; properties count in the order of their names.

    Absent columns count as empty, so frames with and without them agree.
    """
    part = lambda c: F.to_json(F.array_sort(F.map_entries(c))) if c == "props" else F.col(c)
    return objects.withColumn("content_hash", text.content_hash(*(part(c) if c in objects.columns else F.lit("") for c in HASHED)))


@dataclass
class Merged:
    """A new snapshot and what changed: rows of status by path."""

    objects: DataFrame
    links: DataFrame
    status: DataFrame


def merge(old_objects: DataFrame, old_links: DataFrame, new_objects: DataFrame, new_links: DataFrame, kept_files: DataFrame | None = None) -> Merged:
    """Replace what comes from re-parsed files and sweep what is gone.

    Objects and links of files that were skipped (column source_rel of
    ``kept_files``) stay; all others come from the new parse. Links hang on
    their objects, so links of vanished objects go too. new_objects has a
    column seq by which the last of a repeated path wins.
    """
    last = new_objects.groupBy("path").agg(F.max_by(F.struct(*[c for c in new_objects.columns if c not in ("path", "seq")]), "seq").alias("o"))
    fresh = last.select("path", "o.*")
    if kept_files is not None:
        stay = old_objects.join(kept_files, "source_rel", "left_semi").join(fresh.select("path"), "path", "left_anti")
        fresh = fresh.unionByName(stay.select(*fresh.columns))
        parsed = fresh.join(kept_files, "source_rel", "left_anti").select(F.col("path").alias("from_path"))
        old_links = old_links.join(parsed, "from_path", "left_anti")
        new_links = new_links.unionByName(old_links.select(*new_links.columns))
    links = new_links.distinct().join(fresh.select(F.col("path").alias("from_path")), "from_path", "left_semi")
    status = relations.classify_merge(old_objects.select("path", "content_hash"), fresh.select("path", "content_hash", F.lit(0).alias("seq")))
    return Merged(fresh, links, status)


@dataclass
class Snapshot:
    """What is stored of an export: objects with content_hash, source_rel and embed_done, links, and stamps of its files."""

    objects: DataFrame
    links: DataFrame
    stamps: DataFrame


@dataclass
class Update:
    """The next snapshot, what changed in it by path, and what was rejected."""

    snapshot: Snapshot
    status: DataFrame
    rejected: DataFrame


def update(files: DataFrame, old: Snapshot) -> Update:
    """One ingest of an export's files (source_rel, content, mtime, size): stamps, parse of what is new or edited, merge, sweep.

    Files whose stamps are equal are not parsed; objects and links of files that
    are gone go. Objects keep embed_done only while their content hash stays.
    """
    now = files.select(F.col("source_rel").alias("rel_path"), "mtime", "size")
    actions = compare_stamps(old.stamps, now)
    kept = actions.where("action = 'skip'").select(F.col("rel_path").alias("source_rel"))
    todo = actions.where("action IN ('parse', 'added')").select(F.col("rel_path").alias("source_rel"))
    elements = xml_objects.nodes(files.join(todo, "source_rel", "left_semi").where(layout.file_class(F.col("source_rel")) == "object").select("source_rel", "content"))
    elements = cut(elements)
    fresh = with_hash(xml_objects.objects(elements)).withColumn("seq", F.col("id")).drop("id").withColumn("embed_done", F.lit(False))
    merged = merge(old.objects, old.links, fresh, xml_objects.links(elements), kept)
    status = cut(merged.status)
    done = old.objects.where("embed_done").select("path").join(status.where("status = 'unchanged'"), "path", "left_semi").withColumn("_done", F.lit(True))
    objects = merged.objects.drop("embed_done").join(done, "path", "left").withColumn("embed_done", F.coalesce("_done", F.lit(False))).drop("_done")
    return Update(Snapshot(cut(objects), cut(merged.links), now), status, xml_objects.rejected(elements))


def skips_reindex(was_ready: bool, status: DataFrame) -> bool:
    """Whether an index of a ready snapshot still holds: nothing is new, changed or deleted."""
    return was_ready and status.where("status <> 'unchanged'").isEmpty()


def upsert(stored: DataFrame, rows: DataFrame, key: str = "path") -> DataFrame:
    """``stored`` with ``rows`` in place of those of the same key; embed_done falls where the content hash differs."""
    before = stored.select(key, F.col("content_hash").alias("_hash"), F.col("embed_done").alias("_done"))
    fresh = rows.join(before, key, "left").withColumn("embed_done", F.coalesce(F.col("_done") & (F.col("_hash") == F.col("content_hash")), F.lit(False))).drop("_hash", "_done")
    return stored.join(rows.select(key), key, "left_anti").unionByName(fresh.select(*stored.columns))


def mark_embedded(stored: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """``stored`` with embed_done set for the keys of ``done``."""
    return stored.join(done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left").withColumn("embed_done", F.col("embed_done") | F.coalesce("_done", F.lit(False))).drop("_done")


def delta(status: DataFrame) -> DataFrame:
    """(status, n)."""
    return status.groupBy("status").agg(F.count("*").alias("n"))


def call_links(pending: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, counts by status) of calls resolved by unique names."""
    resolved = relations.resolve_calls(pending, methods)
    links = resolved.where("status = 'resolved'").select(F.col("caller").alias("from_path"), F.col("target").alias("to_path"), F.lit("calls").alias("link_type")).distinct()
    return links, resolved.groupBy("status").agg(F.count("*").alias("n"))


def living_methods(methods: DataFrame, objects: DataFrame, forgiving: str = r"\.(Формы|Команды)\.") -> DataFrame:
    """Methods whose parent is alive, or whose form or command stands below a living object."""
    orphans = relations.orphan_methods(methods.select("path", "parent_path"), objects, F.col("parent_path").rlike(forgiving))
    return methods.join(orphans.select("path"), "path", "left_anti")


def passages(objects: DataFrame, size: int = 1100, overlap: int = 130, most: int | None = None, mode: str = "chunks", limits: Limits | None = None) -> DataFrame:
    """(path, ord, text): the meta line of each object with a window of its body (column body; empty or null for none).

    The windows cover the body; ``most`` cuts it after so many. mode is chunks,
    body (the body's head alone, as much as fits) or meta. With ``limits``, sizes
    come from them and meta lines leave room for ``least_body`` characters of
    the body. Help pages (kind Help) have their comment as body; methods add
    their signature to the meta line, forms their structure (column structure).
    """
    has = objects.columns
    parts = [F.col("path"), F.col("name"), F.col("synonym")]
    is_help = F.col("kind") == "Help" if "kind" in has else F.lit(False)
    parts.append(F.when(~is_help, F.col("comment")))
    if "signature" in has:
        parts.append(text.clip(F.col("signature"), SIGNATURE))
    if "structure" in has:
        parts.append(text.clip(F.col("structure"), STRUCTURE))
    meta = F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))
    body = F.coalesce(F.when(is_help, F.col("comment")).otherwise(F.col("body")), F.lit(""))
    if limits is not None:
        limits = limits.reconciled()
        meta = F.when(body == "", text.clip(meta, limits.passage)).otherwise(text.clip(meta, limits.passage - limits.least_body - 1))
        size, overlap = limits.window, limits.overlap
    room = F.lit(limits.passage) - F.length("meta") - 1 if limits is not None else F.lit(size)
    if mode == "meta":
        pieces = F.array(F.lit(""))
    elif mode == "body":
        pieces = F.array(F.substring(F.col("body"), F.lit(1), room))
    else:
        width = F.least(F.lit(size), room)
        pieces = F.when(F.col("body") == "", F.array(F.lit(""))).otherwise(text.windows_of(F.col("body"), width, F.least(F.lit(overlap), (width / 2).cast("int")), most))
    each = objects.select("path", meta.alias("meta"), body.alias("body")).select("path", "meta", F.posexplode(pieces).alias("ord", "piece"))
    return each.select("path", "ord", F.concat_ws("\n", "meta", F.nullif(F.trim("piece"), F.lit(""))).alias("text"))


def pending_passages(passages_now: DataFrame, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to write, to delete): passages whose text is not in the index yet, and index rows that no passage stands behind."""
    now = passages_now.withColumn("h", F.sha2("text", 256))
    return now.join(indexed.select("path", "ord", "h"), ["path", "ord", "h"], "left_anti"), indexed.join(now.select("path", "ord"), ["path", "ord"], "left_anti")


def under_excluded(objects: DataFrame, part: str) -> DataFrame:
    """Objects without those of which the name, or that of an ancestor, has the part."""
    return objects.where(~F.exists(paths.ancestors(F.col("path")), lambda a: F.substring_index(a, ".", -1).contains(part)))
