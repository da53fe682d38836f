"""Aggregations of links, methods, tags and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandmap.functions import paths


def by_owner(usages: DataFrame, excluded: str | None = None, samples: int = 3) -> DataFrame:
    """(owner, n, types, samples): links counted by owner, with counts of each type and the first sample paths.

    Two aggregations, both with partial sums: by owner and type, then by owner.
    """
    rows = usages.withColumn("owner", paths.owner(F.col("from_path")))
    if excluded:
        rows = rows.where(~F.col("owner").startswith(excluded))
    typed = rows.groupBy("owner", "link_type").agg(F.count("*").alias("n"))
    types = typed.groupBy("owner").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "link_type", F.col("n").cast("string")))), ",").alias("types"))
    # The first paths of each owner: the window's limit is pushed before its sort.
    distinct = rows.where("from_path <> owner").select("owner", "from_path").distinct()
    ranked = distinct.withColumn("_n", F.row_number().over(_by_owner())).where(F.col("_n") <= samples)
    picked = ranked.groupBy("owner").agg(F.array_join(F.array_sort(F.collect_list("from_path")), ",").alias("samples"))
    return types.join(picked, "owner", "left").select("owner", "n", "types", F.coalesce("samples", F.lit("")).alias("samples"))


def _by_owner() -> WindowSpec:
    return Window.partitionBy("owner").orderBy("from_path")


def tag_groups(memberships: DataFrame, tag: str, member: str) -> DataFrame:
    """(tag, n_members, members) of the tags with members."""
    return memberships.select(tag, member).distinct().groupBy(tag).agg(F.count("*").alias("n_members"), F.array_join(F.array_sort(F.collect_list(member)), ",").alias("members"))


def with_tags(memberships: DataFrame, tag: str, member: str, wanted: list[str], all_of: bool) -> DataFrame:
    """Members with any, or with all, of the wanted tags."""
    found = memberships.where(F.col(tag).isin(wanted)).groupBy(member).agg(F.countDistinct(tag).alias("n_tags"))
    return found.where(F.col("n_tags") >= (len(set(wanted)) if all_of else 1))


def tool_stats(events: DataFrame, tool: str, is_error, duration: str) -> DataFrame:
    """Calls, errors and mean duration over positive durations, to one place, by tool."""
    d = F.col(duration)
    return events.groupBy(tool).agg(F.count("*").alias("calls"), F.count_if(is_error).alias("errors"), F.bround(F.avg(F.when(d > 0, d)), 1).alias("avg_ms"))


def timeline(events: DataFrame, ts: str, kind: str, kinds: list[str], start, end, minutes: int = 1) -> DataFrame:
    """(bucket, kind, n) for every interval of the span and every given kind, zeros included."""
    width = f"{minutes} minutes"
    inside = events.where((F.col(ts) >= start) & (F.col(ts) < end))
    counted = inside.groupBy(F.window(ts, width).start.alias("bucket"), kind).agg(F.count("*").alias("n"))
    spark = events.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") - F.expr(f"INTERVAL {width}"), F.expr(f"INTERVAL {width}"))).alias("bucket"))
    grid = spine.withColumn(kind, F.explode(F.array(*map(F.lit, kinds))))
    return grid.join(counted, ["bucket", kind], "left").select("bucket", kind, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """Runs of events of a key without a longer pause than the gap."""
    out = events.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
    return out.select(*keys, F.col("w.start").alias("first_ts"), "last_ts", "n")


def with_first(rows: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """(by, n, first): rows of each group, and its first ``most`` distinct values; no more than these are gathered."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(value))
    first = rows.select(*by, value).distinct().withColumn("_n", place).where(F.col("_n") <= most)
    return rows.groupBy(*by).agg(F.count("*").alias("n")).join(first.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("first")), by)
