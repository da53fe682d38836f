"""The engine's tools over one set of frames; every tool returns a frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.functions import paths, refs, text
from strandmap.operators import lookup, ranking, rollups
from strandmap.plans import cards, graph, retrieval, search
from strandmap.plans.index import TextIndex


@dataclass
class Engine:
    """contexts (name, enabled, status), tags (tag, name), objects, links (from_path, to_path, link_type), methods, corpus.

    All frames but contexts and tags have a column context; a tool works on one
    context, given by name, or on all contexts of a tag, given as tag:<name>.
    """

    contexts: DataFrame
    tags: DataFrame
    objects: DataFrame
    links: DataFrame
    methods: DataFrame
    corpus: DataFrame | TextIndex
    profile: retrieval.RankProfile | None = None

    def _names(self, ref: str) -> list[str]:
        """Contexts that a reference names; they are few. An ambiguous or unknown reference raises, with candidates."""
        if ref.startswith("tag:"):
            rows = self.tags.where(F.lower("tag") == ref[4:].lower()).select("name").distinct().collect()
            if rows:
                return sorted(r.name for r in rows)
        rows = lookup.resolve_contexts(self.contexts, ref).collect()
        found = [r.name for r in rows if r.status == "resolved"]
        if not found:
            raise LookupError(f"no context {ref!r}; candidates: {', '.join(sorted(r.name for r in rows)) or 'none'}")
        return found

    def _in(self, frame: DataFrame, ref: str) -> DataFrame:
        return frame.where(F.col("context").isin(self._names(ref)))

    def list_contexts(self) -> DataFrame:
        return self.contexts.where("enabled")

    def list_context_groups(self) -> DataFrame:
        return rollups.tag_groups(self.tags.join(self.contexts.where("enabled").select("name"), "name", "left_semi"), "tag", "name")

    def get_indexing_status(self) -> DataFrame:
        counts = self.methods.groupBy(F.col("context").alias("name")).agg(F.count("*").alias("n_methods"))
        return self.contexts.join(counts, "name", "left").fillna({"n_methods": 0})

    def search_metadata(self, context: str, query: str, kind: str | None = None, prefix: str | None = None, limit: int = 20) -> DataFrame:
        return search.search(self.corpus, query, limit, prefix=prefix, kind=kind, contexts=self._names(context), profile=self.profile)

    def search_under(self, context: str, prefix: str, query: str, limit: int = 20) -> DataFrame:
        return self.search_metadata(context, query, prefix=prefix, limit=limit)

    def semantic_search(self, context: str, query: str, vector: list[float], kind: str | None = None, limit: int = 20) -> DataFrame:
        hits = search.search(self.corpus, query, 4 * limit, vector=vector, kind=kind, contexts=self._names(context), profile=self.profile)
        return ranking.one_per_leaf(hits, F.col("rank")).orderBy("rank").limit(limit)

    def helpsearch(self, context: str, query: str, owner: str | None = None, limit: int = 20) -> DataFrame:
        """Help pages by search; where it finds none, those that hold the query as it is written."""
        prefix = f"Help.{owner}" if owner else None
        found = self.search_metadata(context, query, kind="Help", prefix=prefix, limit=limit)
        if not found.isEmpty():
            return found
        return lookup.containing(self._in(self.objects, context), query, kinds=("Help",), prefix=prefix).orderBy("path").limit(limit)

    def _spellings(self, path: str) -> list[str]:
        """The path as given, its canonical form, and the forms in which links name it."""
        told = F.coalesce(refs.canonical(F.lit(path)), F.lit(path))
        row = self.objects.sparkSession.range(1).select(told.alias("path"), refs.candidates(told).alias("names")).first()
        return list(dict.fromkeys([path, row.path, *row.names]))

    def get_object(self, context: str, path: str) -> DataFrame:
        return self._in(self.objects, context).where(F.col("path").isin(self._spellings(path)))

    def get_object_levels(self, context: str, path: str, level: str = "card") -> dict[str, DataFrame]:
        """An object at a level: card; links adds its links by type; full adds its structure and the objects below."""
        levels = ("card", "links", "full")
        if level not in levels:
            raise ValueError(f"level {level!r}: one of {', '.join(levels)}")
        out = {"card": self.get_object(context, path)}
        if level != "card":
            links = self._in(self.links, context)
            outgoing = links.where(F.col("from_path").isin(self._spellings(path))).select("link_type", F.col("to_path").alias("other"), F.lit("out").alias("direction"))
            incoming = graph.named_usages(links, self._spellings(path)).select("link_type", F.col("from_path").alias("other"), F.lit("in").alias("direction"))
            out["links"] = rollups.with_first(outgoing.unionByName(incoming), ["direction", "link_type"], "other", 50)
        if level == "full":
            out |= {"structure": self.get_structure(context, path), "children": self._in(self.objects, context).where(paths.strictly_under(F.col("path"), path))}
        return out

    def get_structure(self, context: str, path: str) -> DataFrame:
        return cards.structure(self._in(self.objects, context), path)

    def get_object_dossier(self, context: str, path: str) -> DataFrame:
        return cards.dossier(self._in(self.objects, context), self._in(self.links, context), path)

    def compare_objects(self, context: str, left: str, right: str) -> DataFrame:
        return cards.compare(self._in(self.objects, context), left, right)

    def get_required_fields(self, context: str, path: str, words: list[str], adders: str) -> DataFrame:
        return cards.required_fields(self._in(self.objects, context), self._in(self.methods, context), path, words, adders)

    def get_links(self, context: str, path: str, incoming: bool = True) -> DataFrame:
        links = self._in(self.links, context)
        return graph.usages(links, path) if incoming else links.where(F.col("from_path") == path)

    def find_usages(self, context: str, path: str, link_type: str | None = None, expand: bool = False, limit: int = 200, offset: int = 0) -> DataFrame:
        """Who uses an object under any of its names: by owner, or with ``expand`` a page of the links themselves."""
        found = graph.named_usages(self._in(self.links, context), self._spellings(path), link_type)
        if not expand:
            return rollups.by_owner(found)
        return ranking.page(found, limit, offset, F.col("link_type"), F.col("from_path"))

    def get_query_path(self, context: str, source: str, target: str) -> DataFrame:
        return graph.join_paths(self._in(self.links, context), source, target)

    def trace_impact(self, context: str, path: str, depth: int = 2, down: bool = True) -> DataFrame:
        return graph.bounded(graph.impact(self._in(self.links, context), path, min(5, max(1, depth)), down), 2000)

    def trace_call_chain(self, context: str, path: str, depth: int = 2, callers: bool = False) -> DataFrame:
        calls = self._in(self.links, context).where("link_type = 'calls'")
        return graph.bounded(graph.reach(calls, path, min(5, max(1, depth)), callers), 2000)

    def list_code_modules(self, context: str, prefix: str | None = None) -> DataFrame:
        rows = self._in(self.methods, context)
        rows = rows if prefix is None else rows.where(paths.under(F.col("parent_path"), prefix))
        return rows.groupBy("parent_path", "module_role").agg(F.count("*").alias("n_methods"), F.count_if("export").alias("n_exports"))

    def list_methods(self, context: str, parent: str, name: str = "", export_only: bool = False, limit: int = 200) -> DataFrame:
        rows = self._in(self.methods, context).where(F.col("parent_path") == parent)
        return lookup.exact_then_prefix(rows.where("export") if export_only else rows, name, limit)

    def find_methods(self, context: str, name: str, limit: int = 50) -> DataFrame:
        rows = self._in(self.methods, context)
        found = lookup.exact_then_prefix(rows, name, limit)
        if not found.isEmpty():
            return found
        inside = rows.where(F.lower("name").contains(name.lower())).withColumn("stage", F.lit(2)).orderBy("name", "path").limit(limit)
        if not inside.isEmpty():
            return inside
        # Words rather than a name: the hybrid search over methods, by path.
        hits = search.search(self.corpus, name, limit, contexts=self._names(context), profile=self.profile).where(F.col("kind").isin("Procedure", "Function"))
        return rows.join(F.broadcast(hits.select("path", F.col("rank").alias("stage"))), "path")

    def get_method(self, context: str, path: str) -> DataFrame:
        return self._in(self.methods, context).where(F.col("path") == path)

    def get_module_structure(self, context: str, parent: str) -> DataFrame:
        rows = self._in(self.methods, context).where(F.col("parent_path") == parent)
        return rows.select("module_role", "region", "line", "name", "kind", "export", text.preview(F.col("comment")).alias("doc")).orderBy("module_role", "line", "name")

    def find_code_references(self, context: str, needle: str) -> DataFrame:
        """Every match in method bodies with its line in the file."""
        rows = self._in(self.methods, context)
        found = cards.references(rows.select("path", "body"), needle, "path", "body")
        starts = rows.select("path", (F.col("line") + F.size(F.split("header", "\n")) if "header" in rows.columns else F.col("line") + 1).alias("body_line"))
        return found.join(starts, "path").select("path", "nth", (F.col("line") + F.col("body_line") - 1).alias("line"), "snippet")

    def search_forms(self, context: str, query: str, limit: int = 50) -> DataFrame:
        return lookup.containing(self._in(self.objects, context), query).orderBy("path").limit(limit)

    def get_schema_fields(self, context: str, path: str) -> DataFrame:
        """Fields of a report's composition schema: objects of kind DataCompositionField below it."""
        return self._in(self.objects, context).where((F.col("kind") == "DataCompositionField") & paths.under(F.col("path"), path))

    def queue_reembed(self, context: str, kinds: list[str]) -> DataFrame:
        """Objects with the embedding mark taken from the given kinds; written back, they are embedded anew."""
        chosen = F.col("context").isin(self._names(context)) & F.col("kind").isin(kinds)
        return self.objects.withColumn("embed_done", F.when(chosen, F.lit(False)).otherwise(F.col("embed_done") if "embed_done" in self.objects.columns else F.lit(True)))
