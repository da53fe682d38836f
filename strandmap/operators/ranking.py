"""Windows over hits and logs: deduplication, diversification, caps, retention, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmap.functions import paths


def best_per(hits: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def one_per_leaf(hits: DataFrame, *order: Column, deep: int = 3) -> DataFrame:
    """At most one hit for each leaf name among hits of ``deep`` dots or more; others stay."""
    path = F.col("path")
    key = F.when(paths.depth(path) >= deep, F.lower(paths.leaf(path))).otherwise(path)
    w = Window.partitionBy(key).orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | (paths.depth(path) < deep)).drop("_n")


def cap_contexts(hits: DataFrame, context: str, limit: int, n_contexts: int, *order: Column, key: str) -> DataFrame:
    """Order in which each context gives its first ``cap`` hits before any gives more; column overflow marks the rest.

    key tells hits apart. The window's limit is pushed before its sort, so tasks
    hand on the first hits of each context only, and all hits stay in place.
    """
    cap = max(3, -(-limit // max(1, n_contexts)))
    if limit >= 6:
        cap = min(cap, max(3, limit // 2))
    n = F.row_number().over(Window.partitionBy(context).orderBy(*order))
    first = hits.withColumn("_n", n).where(F.col("_n") <= cap).select(key, F.lit(True).alias("_first"))
    return hits.join(first, key, "left").withColumn("overflow", F.col("_first").isNull()).drop("_first")


def retain(log: DataFrame, ts: str, cutoff, most: int, *order: Column) -> DataFrame:
    """Rows at or after the cut-off, the newest ``most`` of them.

    A global limit takes the newest of each task first, so no task sorts the whole log.
    """
    return log.where(F.col(ts) >= cutoff).orderBy(*order).limit(most)


def page(rows: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page of rows with the total and whether more follow."""
    total = rows.count()
    out = rows.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))
    return out.withColumn("total", F.lit(total).cast("long")).withColumn("truncated", F.lit(total > max(0, offset) + max(1, limit)))


def suppress_repeats(errors: DataFrame, key: list[str], *order: Column, shown: int = 8) -> DataFrame:
    """The first ``shown`` rows of a key as shown, the next as suppressed; later ones go."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return errors.withColumn("nth", n).where(F.col("nth") <= shown + 1).withColumn("state", F.when(F.col("nth") <= shown, "shown").otherwise("suppressed"))
