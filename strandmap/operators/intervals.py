"""Joins on nearness in time, as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: int, other_than: Column | None = None) -> DataFrame:
    """Pairs of rows with equal keys where right comes 0 to ``width`` after left (column ``at``, whole numbers).

    Each right row goes to its bucket of that width and to the one before, each
    left row to its own, so the join is on equality and only meets neighbours.
    right must share no column with left but the keys and ``at``.
    """
    l_rows = left.withColumn("_bucket", F.floor(F.col(at) / width))
    r_rows = right.withColumnRenamed(at, "_at").withColumn("_bucket", F.explode(F.array(F.floor(F.col("_at") / width), F.floor(F.col("_at") / width) - 1)))
    out = l_rows.join(r_rows, [*keys, "_bucket"]).where((F.col("_at") >= F.col(at)) & (F.col("_at") <= F.col(at) + width))
    return (out if other_than is None else out.where(other_than)).drop("_bucket").withColumnRenamed("_at", f"{at}_right")
