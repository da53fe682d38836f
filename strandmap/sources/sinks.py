"""What the engine writes: snapshots, logs, audits, exports, clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(frame: DataFrame, path: str, by: str = "entity_id", sort: str = "path") -> None:
    """Replace the partitions of the entities in ``frame`` and no others; rows are dealt and sorted by ranges, so a large entity is many files and scans skip."""
    frame.repartitionByRange(by, sort).sortWithinPartitions(by, sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def write_audit(rejected: DataFrame, path: str) -> None:
    """One JSON line for each rejected file."""
    rejected.write.mode("overwrite").json(path)


def export_text(log: DataFrame, path: str) -> None:
    """Log rows as blocks of text, one a row."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in log.columns]
    log.select(F.concat_ws("\n", *parts).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def clone(frame: DataFrame, source: int, target: int) -> DataFrame:
    """The rows of one entity as rows of another."""
    return frame.where(F.col("entity_id") == source).withColumn("entity_id", F.lit(target).cast("long"))


def clone_all(frames: dict[str, DataFrame], entities: DataFrame, source: int, target: int) -> dict[str, DataFrame]:
    """Every frame's rows of one entity as rows of another: objects, links, stamps, tags, passages alike; only a ready entity is cloned."""
    if entities.where((F.col("entity_id") == source) & (F.col("status") == "ready")).isEmpty():
        raise ValueError(f"entity {source} is not ready")
    if not entities.where(F.col("entity_id") == target).isEmpty():
        raise ValueError(f"entity {target} exists")
    return {name: clone(frame, source, target) for name, frame in frames.items()}


def orphaned(frame: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, n): rows left of entities that are registered no more. Sources outside the store are never touched."""
    return frame.join(entities.select("entity_id"), "entity_id", "left_anti").groupBy("entity_id").agg(F.count("*").alias("n"))


def insert_new(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not stored yet, each once."""
    return rows.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def storage(spark: SparkSession, path: str) -> DataFrame:
    """(folder, files, bytes) below a path, by the first folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def compact(spark: SparkSession, path: str, target: str, files: int) -> None:
    """Rewrite many small files as few."""
    spark.read.parquet(path).repartition(files).write.mode("overwrite").parquet(target)
