"""Connected components of a large set of links: union-find in each task, contraction between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmap.llm.common import lean, ship, stored

_EDGE = "a long, b long"


class UnionFind:
    """Disjoint sets of whole numbers whose roots are their smallest members."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x == y:
            self.parent.setdefault(x, x)
            return
        if y < x:
            x, y = y, x
        self.parent[y] = x
        self.parent.setdefault(x, x)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (root, member) that connect just what the given links connect."""
    sets = UnionFind()
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        sets.union(x, y)
    members = list(sets.parent)
    roots = [sets.find(x) for x in members]
    kept = [(r, x) for r, x in zip(roots, members, strict=True) if r != x]
    pairs = np.array(kept, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


#: Links that one union-find holds at a time, which bounds a task's memory.
FOREST_LINKS = 500_000


def _forests(batches):
    held, n = [], 0

    def flush():
        a = np.concatenate([x for x, _ in held])
        b = np.concatenate([y for _, y in held])
        roots, members = forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(roots), pa.array(members)], names=["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= FOREST_LINKS:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b; whole numbers).

    component is the smallest node that links reach. Each round thins the links
    of a task to a forest, hooks every node to its smallest neighbour, and
    relabels the links; rounds shrink a component at least by half. Nulls and
    loops are ignored; repeated links do no harm; no links give no rows.
    """
    spark = links.sparkSession
    ship(spark)
    edges = links.select("a", "b").where("a is not null and b is not null and a <> b")
    hooks: list[DataFrame] = []
    while True:
        edges = stored(edges.mapInArrow(lean(_forests), _EDGE).distinct(), "forest")
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"))
        hook = stored(hook.withColumnRenamed("a", "node"), "hook")
        # One jump: a hook never leads to a larger node, so hooks form a forest.
        onward = hook.select(F.col("node").alias("to"), F.col("to").alias("far"))
        hook = stored(hook.join(onward, "to", "left").select("node", F.coalesce("far", "to").alias("to")), "jump")
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = hooks[0].select("node", F.col("to").alias("component"))
    for hook in hooks[1:]:
        out = out.join(hook.select(F.col("node").alias("component"), F.col("to").alias("next")), "component", "left")
        out = out.select("node", F.coalesce("next", "component").alias("component"))
    return out
