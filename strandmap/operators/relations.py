"""Joins and set operations of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import paths


def links_to(links: DataFrame, refs: DataFrame) -> DataFrame:
    """Links whose targets are among the references (column ref)."""
    return links.join(refs.select(F.col("ref").alias("to_path")).distinct(), "to_path", "left_semi")


def orphan_links(links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links without a source object, and calls and help links without a target, with the reason."""
    known = objects.select("path").distinct()
    no_source = links.join(known.withColumnRenamed("path", "from_path"), "from_path", "left_anti").withColumn("reason", F.lit("source"))
    pointed = links.where(F.col("link_type").isin("calls", "help", "type"))
    no_target = pointed.join(known.withColumnRenamed("path", "to_path"), "to_path", "left_anti").withColumn("reason", F.lit("target"))
    return no_source.unionByName(no_target)


def orphan_methods(methods: DataFrame, objects: DataFrame, forgiving: Column) -> DataFrame:
    """Methods (path, parent_path) whose parent is gone, unless ``forgiving`` and some ancestor is alive.

    A prefix join turned into an equi-join on the exploded ancestors.
    """
    alive = objects.select(F.col("path").alias("ancestor")).distinct()
    near = methods.join(alive.withColumnRenamed("ancestor", "parent_path"), "parent_path", "left_anti")
    rescued = near.where(forgiving).select("path", F.explode(paths.ancestors(F.col("parent_path"))).alias("ancestor")).join(alive, "ancestor", "left_semi").select("path").distinct()
    return near.join(rescued, "path", "left_anti")


def resolve_calls(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """(caller, callee_name, status, target): resolved by a unique name, else ambiguous, unresolved or self.

    Targets are counted by name before the join, so an ambiguous name stays one row.
    """
    by_name = targets.groupBy(F.col("name").alias("callee_name")).agg(F.count("*").alias("n"), F.min("path").alias("target"))
    out = calls.join(by_name, "callee_name", "left")
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").when(F.col("target") == F.col("caller"), "self").otherwise("resolved")
    return out.select("caller", "callee_name", status.alias("status"), F.when(status == "resolved", F.col("target")).otherwise("").alias("target"))


def classify_merge(old: DataFrame, new: DataFrame, key: str = "path", value: str = "content_hash") -> DataFrame:
    """(key, status): new, changed, unchanged or deleted; the last of new rows with one key counts (column seq)."""
    last = new.groupBy(key).agg(F.max_by(value, "seq").alias("_new"))
    out = old.select(key, F.col(value).alias("_old")).join(last, key, "full_outer")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return out.select(key, status.alias("status"))


def as_of(rows: DataFrame, marks: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Each row with the value of the latest mark strictly before it; rows on a mark, and rows without one, are left out.

    ``order`` holds whole numbers. Spark has no as-of join: marks and rows are
    put together and sorted once.
    """
    others = [c for c in rows.columns if c not in (*by, order)]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    row_side = rows.select(*by, order, *others, F.lit(None).cast(marks.schema[value].dataType).alias("_mark"))
    mark_side = marks.select(*by, order, *(F.lit(None).cast(kinds[c]).alias(c) for c in others), F.col(value).alias("_mark"))
    both = row_side.withColumn("_row", F.lit(True)).unionByName(mark_side.withColumn("_row", F.lit(False)))
    before = F.last("_mark", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    on_mark = F.max(~F.col("_row")).over(Window.partitionBy(*by, order))
    out = both.withColumn(value, before).withColumn("_on", on_mark)
    return out.where(F.col("_row") & ~F.col("_on") & F.col(value).isNotNull()).drop("_mark", "_row", "_on")


def nearest(rows: DataFrame, by: list[str], distance: Column, value: str) -> DataFrame:
    """The value at the smallest distance of each group; ties go to the smaller value."""
    return rows.groupBy(*by).agg(F.min_by(value, F.struct(distance, F.col(value))).alias(value))


def prefer_first(*frames: DataFrame, key: str = "path") -> DataFrame:
    """Union in which a key's row comes from the first frame that has it."""
    both = None
    for i, f in enumerate(frames):
        f = f.withColumn("_from", F.lit(i))
        both = f if both is None else both.unionByName(f)
    w = Window.partitionBy(key).orderBy("_from")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")


def with_owner_rows(hits: DataFrame) -> DataFrame:
    """Hits and synthetic rows for their owners (0.97 of the best hit below), where the owner is no hit itself."""
    owners = hits.where(paths.depth(F.col("path")) > 1).groupBy(paths.owner(F.col("path")).alias("path")).agg((F.max("score") * 0.97).alias("score"))
    owners = owners.join(hits.select("path"), "path", "left_anti").withColumn("synthetic", F.lit(True))
    return hits.select("path", "score").withColumn("synthetic", F.lit(False)).unionByName(owners.select("path", "score", "synthetic"))


def set_difference(pairs: DataFrame, side: str, item: str, a, b) -> DataFrame:
    """(item, place): only_a, only_b or both, of two sides' item sets."""
    both = pairs.where(F.col(side).isin(a, b)).groupBy(item).agg(F.max((F.col(side) == a).cast("int")).alias("_a"), F.max((F.col(side) == b).cast("int")).alias("_b"))
    return both.select(item, F.when(F.col("_a") + F.col("_b") == 2, "both").when(F.col("_a") == 1, "only_a").otherwise("only_b").alias("place"))


def enriched(rows: DataFrame, more: DataFrame, key: str, column: str, alias: str) -> DataFrame:
    """Rows with a text of their own, or else that of ``more`` for their key, or else an empty one."""
    theirs = more.select(key, F.col(column).alias("_theirs"))
    own = F.nullif(F.col(alias), F.lit("")) if alias in rows.columns else F.lit(None).cast("string")
    return rows.join(theirs, key, "left").withColumn(alias, F.coalesce(own, "_theirs", F.lit(""))).drop("_theirs")


def fill_forward(rows: DataFrame, by: list[str], order: str, values: dict[str, Column], piece: int = 50_000) -> DataFrame:
    """Add columns with the latest non-null value at or before each row of a group.

    A long group is cut into pieces by its order, which is filled on its own;
    what each piece hands on is one row, so that no group has to fit into a task.
    """
    cut = rows.withColumn("_piece", F.floor(F.col(order) / piece)).withColumns({f"_v_{n}": c for n, c in values.items()})
    inside = Window.partitionBy(*by, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = cut.groupBy(*by, "_piece").agg(*(F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in values))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.select(*by, "_piece", *(F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_h_{n}") for n in values))
    filled = cut.withColumns({n: F.last(f"_v_{n}", ignorenulls=True).over(inside) for n in values}).join(handed, [*by, "_piece"])
    return filled.select(*rows.columns, *(F.coalesce(n, f"_h_{n}").alias(n) for n in values))
