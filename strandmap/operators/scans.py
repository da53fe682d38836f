"""Running sums of long groups, piece by piece."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, by: list[str], order: str, values: dict[str, Column], floored: Collection[str] = (), piece: int = 50_000) -> DataFrame:
    """Add the sum of each value over a group's rows up to and with each row; nulls count as 0.

    A ``floored`` sum is one of opens (1) and closes (-1) that never falls below
    zero: a close without its open counts for nothing. A piece of ``order``
    hands on two numbers for each value, its total and its lowest prefix, which
    combine as (t1 + t2, min(low1, t1 + low2)); so no group has to fit into a
    task, however its opens and closes lie. ``order`` holds whole numbers, unique
    within a group; a null in ``by`` is a group of its own.
    """
    cut = rows.withColumn("_piece", F.floor(F.col(order) / piece)).withColumns({f"_v_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in values.items()})
    inside = Window.partitionBy(*by, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = cut.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in values})
    ends = cut.groupBy(*(F.col(b).alias(f"_k{i}") for i, b in enumerate(by)), F.col("_piece").alias("_p")).agg(
        *(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values), *(F.min(f"_s_{n}").alias(f"_m_{n}") for n in floored)
    )
    before = Window.partitionBy(*(f"_k{i}" for i in range(len(by)))).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    handed = ends.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in values})
    if floored:
        handed = handed.withColumns({f"_l_{n}": F.coalesce(F.min(F.col(f"_b_{n}") + F.col(f"_m_{n}")).over(before), F.lit(0)) for n in floored})
        cut = cut.withColumns({f"_m_{n}": F.min(f"_s_{n}").over(inside) for n in floored})
    handed = handed.drop(*(f"_t_{n}" for n in values), *(f"_m_{n}" for n in floored))
    same = F.col("_piece") == F.col("_p")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    joined = cut.join(handed, same)

    def total(n: str) -> Column:
        whole = F.col(f"_b_{n}") + F.col(f"_s_{n}")
        return whole - F.least(F.lit(0), F.col(f"_l_{n}"), F.col(f"_b_{n}") + F.col(f"_m_{n}")) if n in floored else whole

    return joined.select(*rows.columns, *(total(n).alias(n) for n in values))
