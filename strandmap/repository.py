"""An export as generations of parsed files: one update parses what is new or edited of every class of file.

Contents are read once for each class that has such files, and by no join: only
descriptions are dealt out, as small files are packed densely.

The unit is a file. A generation adds a segment with all that the parsed files
say (objects, links, methods, calls, help, forms) and tombstones of files that
are edited or gone; a manifest makes it visible at once, so a job that dies
between its steps leaves the last generation as it was, and readers who pinned
one are not disturbed. See ``plans.segments``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap import ingest, manifest
from strandmap.functions import refs, text
from strandmap.operators import relations
from strandmap.plans import segments
from strandmap.plans.segments import Folder, Segments
from strandmap.sources import binary_forms, help_html, layout, modules, xml_objects

_FILE = "source_rel"
_SCHEMAS = {
    "stamps": "source_rel string, mtime long, size long, class string",
    "objects": "source_rel string, seq long, path string, kind string, name string, synonym string, comment string, belong string, base_object string, props map<string,array<string>>, structure string, content_hash string",
    "links": "source_rel string, from_path string, to_ref string, to_path string, link_type string",
    "methods": "source_rel string, path string, parent_path string, module_role string, name string, kind string, export boolean, signature string, comment string, body string, region string, line int, end_line int, calls array<string>",
    "calls": "source_rel string, caller string, callee_name string",
    "rejected": "source_rel string, reason string",
}


@dataclass(frozen=True)
class Repository:
    """A generation of an export; its frames read that generation alone, whatever is committed later."""

    live: Segments

    @property
    def generation(self) -> int:
        return self.live.generation

    def part(self, name: str) -> DataFrame:
        return self.live.read(name)

    @property
    def objects(self) -> DataFrame:
        """Objects, help pages and forms among them; of a path that several files tell, the last file counts."""
        return self.objects_with(*(c for c in self.part("objects").columns if c != "path"))

    def objects_with(self, *columns: str) -> DataFrame:
        """The objects with their path and these columns; others, such as long comments, are not moved."""
        last = self.part("objects").groupBy("path").agg(F.max_by(F.struct(*columns), F.struct(_FILE, "seq")).alias("o"))
        return last.select("path", "o.*")

    @property
    def links(self) -> DataFrame:
        """Links as files tell them, and calls that name exactly one method of the whole export."""
        told = self.part("links").select("from_path", F.coalesce("to_path", "to_ref").alias("to_path"), "link_type")
        calls = ingest.call_links(self.part("calls").select("caller", "callee_name").distinct(), self.part("methods"))[0]
        return told.unionByName(calls).distinct()

    @property
    def methods(self) -> DataFrame:
        return self.part("methods")


def _as(rows: DataFrame, name: str) -> DataFrame:
    """Rows with the columns and types of a part; absent ones are empty."""
    wanted = rows.sparkSession.createDataFrame([], _SCHEMAS[name]).schema
    empty = lambda f: F.lit("") if f.dataType.typeName() == "string" else F.lit(None)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else empty(f)).cast(f.dataType).alias(f.name) for f in wanted.fields))


def open_at(spark: SparkSession, root: str, generation: int | None = None) -> Repository:
    """The newest generation below a folder, or a pinned one; the first, without files, if there is none yet."""
    if generation is None and manifest.read(spark, root) is None:

        def nothing(folder: Folder) -> dict:
            for name, schema in _SCHEMAS.items():
                folder.put(name, spark.createDataFrame([], schema))
            return {"rows": 0}

        return Repository(segments.create(spark, root, _FILE, nothing))
    return Repository(segments.load(spark, root, generation))


def _all(spark: SparkSession, name: str, frames: list[DataFrame]) -> DataFrame:
    """Rows of a part out of any number of frames, objects with their hash."""
    rows = reduce(DataFrame.unionByName, (_as(f, name) for f in frames)) if frames else spark.createDataFrame([], _SCHEMAS[name])
    return ingest.with_hash(rows) if name == "objects" else rows


def _parsed(files: DataFrame, classes: set[str]) -> dict[str, list[DataFrame]]:
    """What files (source_rel, content, class) of these classes say, part by part; for other classes nothing is read."""
    of = lambda *names: files.where(F.col("class").isin(*names))
    said: dict[str, list[DataFrame]] = {"objects": [], "links": [], "rejected": [], "methods": []}

    def add(**parts: DataFrame) -> None:
        for name, rows in parts.items():
            said[name].append(rows)

    if "object" in classes:
        add(**_descriptions(of("object")))
    if "form" in classes:
        add(**_forms(of("form")))
    if "template" in classes:
        add(**_templates(of("template")))
    owner = layout.owner_path(F.col(_FILE))
    if "help" in classes:
        pages = of("help").select(_FILE, owner.alias("owner"), F.decode("content", "UTF-8").alias("html")).where("owner <> ''")
        place = F.substring(F.col("path"), F.length(owner) + F.length(F.lit("Help..")) + 1, F.length("path")).try_cast("long")
        name = F.coalesce(F.nullif("heading", F.lit("")), F.substring_index(owner, ".", -1))
        add(objects=help_html.passages(pages, _FILE, "owner").select(_FILE, F.coalesce(place, F.lit(0)).alias("seq"), "path", F.lit("Help").alias("kind"), name.alias("name"), F.col("body").alias("comment")))
    code = []
    if "module" in classes:
        code.append(of("module").select(_FILE, owner.alias("parent_path"), modules.role_of(F.col(_FILE)).alias("module_role"), F.decode("content", "UTF-8").alias("text")))
    if "binary_form" in classes:
        code.append(of("binary_form").select(_FILE, owner.alias("parent_path"), F.lit("FormModule").alias("module_role"), binary_forms.extracted(F.col("content")).alias("text")))
    if code:
        # Modules of earlier dumps begin with a byte order mark.
        add(methods=modules.methods(modules.lines_of(reduce(DataFrame.unionByName, code).withColumn("text", F.ltrim("text", F.lit("\ufeff"))))))
    return said


def _descriptions(files: DataFrame) -> dict[str, DataFrame]:
    """Objects, links and rejected files of descriptions; files are dealt out before they are parsed."""
    elements = ingest.cut(xml_objects.nodes(files.select(_FILE, "content").repartition(_FILE)))
    objects = xml_objects.objects(elements).withColumnRenamed("id", "seq")
    belongs = objects.select(F.col("path").alias("from_path"), _FILE)
    links = xml_objects.links(elements).join(belongs, "from_path").withColumn("to_path", refs.canonical(F.col("to_ref")))
    return {"objects": objects, "links": links, "rejected": xml_objects.rejected(elements)}


def _forms(files: DataFrame) -> dict[str, DataFrame]:
    """Forms with their structure, and broken ones."""
    shapes = ingest.cut(xml_objects.nodes(files.select(_FILE, "content")))
    owner = layout.owner_path(F.col(_FILE))
    structures = xml_objects.form_structure(shapes).select(_FILE, F.lit(0).alias("seq"), owner.alias("path"), F.lit("Form").alias("kind"), F.substring_index(owner, ".", -1).alias("name"), "structure")
    return {"objects": structures, "rejected": xml_objects.rejected(shapes.where("error IS NOT NULL"))}


def _templates(files: DataFrame) -> dict[str, DataFrame]:
    """Fields of composition schemas, and broken templates."""
    inner = ingest.cut(xml_objects.nodes(files.where(F.col(_FILE).endswith(".xml")).select(_FILE, "content")))
    schemas = xml_objects.classify(inner).where("kind = 'schema'").select(_FILE)
    fields = xml_objects.schema_fields(inner).join(schemas, _FILE, "left_semi").where("data_path <> ''")
    path = F.concat_ws(".", layout.owner_path(F.col(_FILE)), "data_path")
    fields = fields.select(_FILE, F.lit(0).alias("seq"), path.alias("path"), F.lit("DataCompositionField").alias("kind"), F.col("data_path").alias("name"), F.col("field").alias("synonym"))
    return {"objects": fields, "rejected": xml_objects.rejected(inner.where("error IS NOT NULL"))}


def update(now: Repository, files: DataFrame) -> Repository:
    """The next generation from all files of an export (source_rel, content, mtime, size); ``now`` if no stamp differs.

    Only files that are new or edited are parsed; what others said stays where
    it is stored. FileExistsError if another update was faster.
    """
    told = files.select(F.col(_FILE).alias("rel_path"), "mtime", "size")
    kept = now.part("stamps").select(F.col(_FILE).alias("rel_path"), "mtime", "size")
    actions = ingest.cut(ingest.compare_stamps(kept, told, stamped=True).where("action <> 'skip'").withColumn("class", layout.file_class(F.col("rel_path"))))
    if actions.isEmpty():
        return now
    gone = actions.where("action <> 'added'").select(F.col("rel_path").alias(_FILE))
    todo = actions.where("action IN ('parse', 'added') AND rel_path IS NOT NULL").withColumnRenamed("rel_path", _FILE)
    n = {r["class"]: r["count"] for r in todo.groupBy("class").count().collect()}  # a class is one of a few
    fresh = files.where(F.col(_FILE).isNotNull()).withColumn("class", layout.file_class(F.col(_FILE))).where(F.col("class").isin(*n))
    if now.live.total("rows"):  # else all files are new
        keys = todo.select(_FILE)
        fresh = fresh.join(F.broadcast(keys) if sum(n.values()) <= segments.BROADCAST_KEYS else keys, _FILE, "left_semi")

    def write(folder: Folder) -> dict:
        folder.put("stamps", _as(todo, "stamps"))
        said = _parsed(fresh, set(n))
        told = {name: folder.put(name, _all(files.sparkSession, name, rows)) for name, rows in said.items()}
        # Calls come from the methods as they are stored, so that modules are parsed once.
        calls = told["methods"].select(_FILE, F.col("path").alias("caller"), F.explode("calls").alias("callee_name")).distinct()
        folder.put("calls", _as(calls, "calls"))
        return {"rows": sum(n.values())}

    return Repository(segments.change(now.live, gone, {"rows": gone.count()}, write))


def compact(now: Repository) -> Repository:
    """Merge segments that are due."""

    def rewrite(due: list[dict], folder: Folder) -> dict:
        for name in _SCHEMAS:
            order = "path" if name in ("objects", "methods") else _FILE
            rows = now.live.read(name, of=due)
            folder.put(name, rows.repartitionByRange(order, _FILE).sortWithinPartitions(order) if name != "stamps" else rows)
        return {"rows": now.live.read("stamps", of=due).count()}

    return Repository(segments.compact(now.live, rewrite))


def changes(before: Repository, after: Repository) -> DataFrame:
    """(path, status) of all objects between two generations: new, changed, unchanged, deleted."""
    return relations.classify_merge(before.objects_with("content_hash"), after.objects_with("content_hash").withColumn("seq", F.lit(0)))


def edits(before: Repository, after: Repository) -> tuple[DataFrame, DataFrame]:
    """(objects that are new or changed, paths that are gone): what an index of ``before`` needs to become one of ``after``."""
    status = ingest.cut(changes(before, after).where("status <> 'unchanged'"))
    return after.objects.join(status.where("status <> 'deleted'"), "path", "left_semi"), status.where("status = 'deleted'").select("path")


def passage_text() -> F.Column:
    """The text of an object for a full-text index: its names, comment and, of forms, their structure."""
    return text.meta_text(F.col("path"), F.col("name"), F.col("synonym"), F.col("comment"), F.col("structure"))
