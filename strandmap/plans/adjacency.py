"""Links that walks meet step by step: stored in both directions for many walks, or made from their tables for one.

Stored links are in buckets of the object that they leave or enter. A step of
a walk reads the buckets of its frontier alone while that is short, and else
joins by bucket, so links are neither scanned whole nor shuffled. Storing them
moves and sorts all links twice, which a walk or two don't pay back: they meet
links as their tables tell them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmap.functions import paths

#: Paths of a frontier that become literals of a filter, by which buckets are pruned.
LITERALS = 256
#: Longer frontiers of up to this many nodes are broadcast to links that are not in buckets.
BROADCAST_NODES = 100_000
#: Links of a bucket on average, which one task sorts; buckets at least.
BUCKET_LINKS, LEAST_BUCKETS = 2_000_000, 16
_COLUMNS = ("from_path", "to_path", "link_type")
_HEADS = {"from_path": "from_head", "to_path": "to_head"}


@dataclass(frozen=True)
class Adjacency:
    """leaving and entering: from_path, to_path, link_type and ``node``, the owner of the one or the other end, by which rows are bucketed."""

    leaving: DataFrame
    entering: DataFrame

    @property
    def sparkSession(self) -> SparkSession:
        return self.leaving.sparkSession

    def met(self, frontier: DataFrame, end: str) -> DataFrame:
        """Links of which an end (from_path or to_path) is a path of the frontier (column node)."""
        return self._joined(frontier.select(paths.owner(F.col("node")).alias("node"), F.col("node").alias(end)), end)

    def of_owners(self, frontier: DataFrame, end: str) -> DataFrame:
        """Links of which an end belongs to an object of the frontier (column node), with that object as node."""
        return self._joined(frontier.select("node"), end, own=True)

    def _joined(self, wanted: DataFrame, end: str, own: bool = False) -> DataFrame:
        table = self.leaving if end == "from_path" else self.entering
        wanted = wanted.where(F.col("node").isNotNull())  # a null path meets nothing
        few = wanted.limit(LITERALS + 1).collect()  # LITERALS rows and one
        columns = ["node", *_COLUMNS] if own else list(_COLUMNS)
        if len(few) <= LITERALS:
            test = F.col("node").isin(sorted({r.node for r in few}))
            if not own:
                test &= F.col(end).isin(sorted({r[end] for r in few}))
            return table.where(test).select(*columns)
        # By bucket first: only links of the frontier's owners move on to meet its paths.
        near = table.join(wanted.select("node").distinct(), "node", "left_semi")
        return (near if own else near.join(wanted.select(end).distinct(), end, "left_semi")).select(*columns)


@dataclass(frozen=True)
class Derived:
    """Links that each step makes anew from their tables, so that nothing is stored, sorted or moved but what meets its frontier.

    links: from_path, to_path, link_type, and from_head and to_head, the first
    segments of the paths. Where these are literals of the parts of a union, a
    part whose paths all have a head that the frontier lacks holds none of its
    links and drops out of the plan.
    """

    links: DataFrame

    @property
    def sparkSession(self) -> SparkSession:
        return self.links.sparkSession

    def met(self, frontier: DataFrame, end: str) -> DataFrame:
        """See ``Adjacency``."""
        return self._joined(self.links, frontier, end, end).select(*_COLUMNS)

    def of_owners(self, frontier: DataFrame, end: str) -> DataFrame:
        """See ``Adjacency``."""
        return self._joined(self.links.withColumn("node", paths.owner(F.col(end))), frontier, end, "node").select("node", *_COLUMNS)

    def _joined(self, rows: DataFrame, frontier: DataFrame, end: str, key: str) -> DataFrame:
        wanted = frontier.where(F.col("node").isNotNull()).select(F.col("node").alias(key))  # a null path meets nothing
        few = [r[0] for r in wanted.limit(LITERALS + 1).collect()]  # LITERALS rows and one
        if len(few) <= LITERALS:
            return rows.where(F.col(_HEADS[end]).isin(sorted({n.split(".")[0] for n in few})) & F.col(key).isin(sorted(set(few))))
        heads = [r[0] for r in wanted.select(paths.head(F.col(key))).distinct().limit(LITERALS + 1).collect()]
        if len(heads) <= LITERALS:
            rows = rows.where(F.col(_HEADS[end]).isin(sorted(heads)))
        short = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        return rows.join(F.broadcast(wanted) if short else wanted, key, "left_semi")


def build(links: DataFrame, path: str, buckets: int | None = None) -> None:
    """Store links (from_path, to_path, link_type) below a folder, unless told in as many buckets as their number asks for."""
    buckets = buckets or max(LEAST_BUCKETS, -(-links.count() // BUCKET_LINKS))
    name = _name(path)
    for part, end in (("leaving", "from_path"), ("entering", "to_path")):
        rows = links.select(paths.owner(F.col(end)).alias("node"), *_COLUMNS)
        # Rows are dealt as they are bucketed, so each bucket is one file.
        dealt = rows.repartition(buckets, "node")
        dealt.write.bucketBy(buckets, "node").sortBy("node", end).option("path", f"{path}/{part}").format("parquet").saveAsTable(f"{name}_{part}")


def load(spark: SparkSession, path: str) -> Adjacency:
    """What this application has stored: buckets are told by the session's catalog."""
    name = _name(path)
    return Adjacency(spark.table(f"{name}_leaving"), spark.table(f"{name}_entering"))


def _name(path: str) -> str:
    return "links_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex
