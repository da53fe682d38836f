"""Structured Streaming forms of the telemetry and of the ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Events from a folder of Parquet files; ts is a timestamp for event time."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def timeline(stream: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """(bucket, event_type, n) by tumbling windows; events later than ``late`` are left out."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, first_ts, n): runs of events without a longer pause."""
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("first_ts"), "n")


def without_repeats(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first event of a key within the watermark's delay; state of older keys is dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def fan_out(stream: DataFrame, seconds: int = 30) -> DataFrame:
    """Pairs of events of one user and kind in different contexts within so many seconds: an interval join of the stream with itself."""
    a = stream.select(F.col("user_id"), F.col("event_type"), F.col("context").alias("context_a"), F.col("ts").alias("ts_a")).withWatermark("ts_a", "1 minute")
    b = stream.select(F.col("user_id").alias("u"), F.col("event_type").alias("e"), F.col("context").alias("context_b"), F.col("ts").alias("ts_b")).withWatermark("ts_b", "1 minute")
    near = F.expr(f"user_id = u AND event_type = e AND context_a <> context_b AND ts_b >= ts_a AND ts_b <= ts_a + INTERVAL {seconds} SECONDS")
    return a.join(b, near).drop("u", "e")


def ingest_files(spark: SparkSession, path: str, checkpoint: str, merge_batch, glob: str = "*") -> StreamingQuery:
    """Feed new files of a folder to ``merge_batch(frame, epoch)``; the checkpoint makes a restart go on where it stopped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
