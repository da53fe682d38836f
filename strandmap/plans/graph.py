"""Dependency and call graphs over links (from_path, to_path, link_type)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.functions import paths
from strandmap.plans.adjacency import BROADCAST_NODES, Adjacency, Derived
from strandmap.session import cut


def _frontier(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else df


def usages(links: DataFrame, path: str, link_type: str | None = None, below: bool = False) -> DataFrame:
    """Links to a path, or also to what lies below it."""
    target = paths.under(F.col("to_path"), path) if below else F.col("to_path") == path
    found = links.where(target)
    return found if link_type is None else found.where(F.col("link_type") == link_type)


def named_usages(links: DataFrame, names: list[str], link_type: str | None = None) -> DataFrame:
    """Links to any of the names by which an object may be referred to (see ``refs.candidates``)."""
    found = links.where(F.col("to_path").isin(names))
    return found if link_type is None else found.where(F.col("link_type") == link_type)


def bounded(found: DataFrame, most: int) -> DataFrame:
    """The nearest ``most`` rows of a walk, by depth, type and path, with whether more were found."""
    more = found.limit(most + 1).count() > most
    return found.orderBy("depth", *(c for c in ("link_type",) if c in found.columns), "path").limit(most).withColumn("truncated", F.lit(more))


class _Scanned:
    """Links without an adjacency: every step reads all of them, from the cache."""

    def __init__(self, links: DataFrame):
        self.links = links.select("from_path", "to_path", "link_type").persist()

    def met(self, frontier: DataFrame, end: str) -> DataFrame:
        return self.links.join(_frontier(frontier).select(F.col("node").alias(end)), end, "left_semi")

    def of_owners(self, frontier: DataFrame, end: str) -> DataFrame:
        rows = self.links.withColumn("node", paths.owner(F.col(end)))
        return rows.join(_frontier(frontier).select("node"), "node", "left_semi")


@contextmanager
def _walkable(links: DataFrame | Adjacency | Derived):
    if isinstance(links, (Adjacency, Derived)):
        yield links
        return
    scanned = _Scanned(links)
    try:
        yield scanned
    finally:
        scanned.links.unpersist()  # what is found is kept in the checkpoint folder


def _start(links: DataFrame | Adjacency | Derived, node: str) -> DataFrame:
    return links.sparkSession.createDataFrame([(node,)], "node string")


def impact(links: DataFrame | Adjacency | Derived, start: str, depth: int, down: bool = True) -> DataFrame:
    """(path, link_type, depth) of the edges met from ``start``, each at its least depth.

    down follows links to a node and goes on from the owner of their source; up
    follows links from a node. Each step joins the whole frontier at once; nodes
    seen before are never expanded again, so cycles end. With an adjacency a
    step reads its own buckets, derived links are read from their tables; a
    plain frame is persisted while the steps run.
    """
    frontier = seen = _start(links, start)
    none = frontier.select(F.col("node").alias("path"), F.lit("").alias("link_type"), F.lit(0).alias("depth")).limit(0)
    found = none
    key, other = ("to_path", "from_path") if down else ("from_path", "to_path")
    with _walkable(links) as graph:
        for d in range(1, depth + 1):
            met = graph.met(frontier, key)
            met = cut(met.select(F.col(other).alias("path"), "link_type").distinct().withColumn("depth", F.lit(d)))
            found = found.unionByName(met)
            if d == depth:
                break
            step = met.select((paths.owner(F.col("path")) if down else F.col("path")).alias("node")).distinct()
            frontier = cut(step.join(seen, "node", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
    return found.groupBy("path", "link_type").agg(F.min("depth").alias("depth"))


def reach(links: DataFrame | Adjacency | Derived, start: str, depth: int, callers: bool = False, link_type: str | None = None) -> DataFrame:
    """(path, depth) of the nodes reached from ``start``, at their first depth, without it; by links of one type, if told."""
    frontier = _start(links, start)
    seen = frontier.withColumn("depth", F.lit(0))
    key, other = ("to_path", "from_path") if callers else ("from_path", "to_path")
    with _walkable(links) as graph:
        for d in range(1, depth + 1):
            met = graph.met(frontier, key)
            met = met if link_type is None else met.where(F.col("link_type") == link_type)
            step = met.select(F.col(other).alias("node")).distinct()
            frontier = cut(step.join(seen, "node", "left_anti"))
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    return seen.where("depth > 0").select(F.col("node").alias("path"), "depth")


#: Columns of a hop of a path between objects.
_HOP = "hop int, from_object string, to_object string, from_path string, to_path string, link_type string, direction string"


def path_between(links: DataFrame | Adjacency | Derived, source: str, target: str, most: int = 6) -> DataFrame:
    """A shortest path between two objects, along links of either direction: one row a hop, none if it would take more than ``most``.

    Both ends grow at once, the smaller frontier first; each object keeps the
    link by which it was first met, the least of several, so a rerun finds the
    same path. direction is forward where the hop follows its link. Going back
    along these links takes one small lookup a hop.
    """
    spark = _start(links, source).sparkSession
    empty = spark.createDataFrame([], _HOP)
    if source == target:
        return empty
    link = "struct<near:string,from_path:string,to_path:string,link_type:string,forward:boolean>"
    sides = []
    for node in (source, target):
        first = spark.createDataFrame([(node,)], "node string").withColumn("link", F.lit(None).cast(link)).withColumn("hops", F.lit(0))
        sides.append({"seen": first, "frontier": first, "n": 1, "hops": 0})
    meeting = None
    with _walkable(links) as graph:
        while meeting is None and sides[0]["hops"] + sides[1]["hops"] < most and all(s["n"] for s in sides):
            here, there = sorted(sides, key=lambda s: (s["n"], sides.index(s)))
            nodes = here["frontier"].select("node")
            met = None
            for end, far, forward in (("from_path", "to_path", True), ("to_path", "from_path", False)):
                rows = graph.of_owners(nodes, end).select(paths.owner(F.col(far)).alias("node"), F.struct(F.col("node").alias("near"), "from_path", "to_path", "link_type", F.lit(forward).alias("forward")).alias("link"))
                met = rows if met is None else met.unionByName(rows)
            fresh = met.groupBy("node").agg(F.min("link").alias("link")).join(here["seen"].select("node"), "node", "left_anti")
            here["hops"] += 1
            here["frontier"] = cut(fresh.withColumn("hops", F.lit(here["hops"])))
            here["n"] = here["frontier"].count()
            here["seen"] = here["seen"].unionByName(here["frontier"])
            meeting = here["frontier"].select("node").join(there["seen"].select("node", F.col("hops").alias("_h")), "node").orderBy("_h", "node").first()
    if meeting is None:
        return empty
    back = []
    for i, side in enumerate(sides):
        node, steps = meeting.node, []
        while (row := side["seen"].where(F.col("node") == node).first()).link is not None:
            at, other = row.link.near, node
            ends = (at, other) if i == 0 else (other, at)
            forward = row.link.forward if i == 0 else not row.link.forward
            steps.append((*ends, row.link.from_path, row.link.to_path, row.link.link_type, "forward" if forward else "backward"))
            node = at
        back.append(steps)
    hops = back[0][::-1] + back[1]
    return spark.createDataFrame([(n, *h) for n, h in enumerate(hops, 1)], _HOP)


def join_paths(links: DataFrame, source: str, target: str) -> DataFrame:
    """Fields by which two objects can be joined: links from below the one to the other, in both directions.

    container is the table section that holds the field, empty for a field of the object itself.
    """
    one = links.where(paths.under(F.col("from_path"), source) & (F.col("to_path") == target)).withColumn("direction", F.lit("forward"))
    two = links.where(paths.under(F.col("from_path"), target) & (F.col("to_path") == source)).withColumn("direction", F.lit("backward"))
    both = one.unionByName(two)
    base = F.when(F.col("direction") == "forward", F.lit(source)).otherwise(F.lit(target))
    found = both.groupBy("direction", "from_path", "to_path").agg(F.array_join(F.array_sort(F.collect_set("link_type")), ",").alias("types")).withColumn("field", paths.relative(F.col("from_path"), base))
    parts = F.split("field", r"\.")
    return found.withColumn("container", F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(""))


def query_paths(links: DataFrame, graph: DataFrame | Adjacency | Derived, source: str, targets: list[str], most: int = 6) -> dict[str, DataFrame]:
    """How to get from an object to each of a target and its fallbacks: the fields that join them, or where no link does, a path over other objects."""
    out = {}
    for target in targets:
        direct = join_paths(links, source, target)
        out[target] = path_between(graph, source, target, most) if direct.isEmpty() else direct
    return out


def resolve_name(objects: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path): for each bare name the shortest path that ends in it, then the first; names that nothing has are left out."""
    found = objects.select("path", "name").join(names.select("name").distinct(), "name")
    return found.groupBy("name").agg(F.min_by("path", F.struct(paths.depth(F.col("path")), F.length("path"), F.col("path"))).alias("path"))
