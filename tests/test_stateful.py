"""Streams with state and timers against their batch forms."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandmap.operators import ranking, rollups
from strandmap.streaming import stateful, telemetry


@pytest.fixture(scope="module")
def replayed(spark, sf, tmp_path_factory):
    """Events in six files of whole days, rows within a file in any order."""
    folder = str(tmp_path_factory.mktemp("replay") / "events")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    days = [r[0] for r in batch.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for n in range(6):
        part = days[len(days) * n // 6 : len(days) * (n + 1) // 6]
        batch.where(F.to_date("ts").isin(part)).orderBy(F.hash("event_id")).coalesce(1).write.mode("append").parquet(folder)
    return folder, batch


def run(spark, tmp_path, folder, schema, job):
    stateful.drain(spark, lambda: job(telemetry.events(spark, folder, schema, files_per_trigger=2)), str(tmp_path / "out"), str(tmp_path / "ck"))
    return spark.read.parquet(str(tmp_path / "out")).collect()


def watermark(rows, minutes=10):
    last = rows.agg(F.max("ts")).first()[0]
    return last.replace(microsecond=last.microsecond // 1000 * 1000) - dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("period", [None, "1 day"])
def test_suppression_equals_batch(spark, replayed, tmp_path, period):
    folder, batch = replayed
    errors = batch.where("event_type IN ('error', 'view')").withColumn("ts", F.col("ts").cast("timestamp"))
    got = run(spark, tmp_path, folder, batch.schema, lambda s: stateful.suppress_repeats(s.where("event_type IN ('error', 'view')"), ["event_type"], shown=8, period=period))
    keys = ["event_type", *(["day"] if period else [])]
    want = ranking.suppress_repeats(errors.where(F.col("ts") <= watermark(errors)).withColumn("day", F.to_date("ts")), keys, F.col("ts"), F.col("event_id"))
    assert {(r.event_id, r.nth, r.state, r.ts) for r in got} == {(r.event_id, r.nth, r.state, r.ts) for r in want.collect()}
    assert len(got) == want.count() > (9 if period else 0)
    assert {r.state for r in got} == {"shown", "suppressed"}


def test_suppression_of_ties_and_nulls(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, None, t) for i in range(12)] + [(50, "a", t), (51, "a", None), (99, "b", t + dt.timedelta(days=1))]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp_ntz").coalesce(1).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    got = run(spark, tmp_path, folder, schema, lambda s: stateful.suppress_repeats(s, ["user_id"], shown=3))
    assert sorted((r.user_id or "", r.event_id, r.nth, r.state) for r in got) == [("", 0, 1, "shown"), ("", 1, 2, "shown"), ("", 2, 3, "shown"), ("", 3, 4, "suppressed"), ("a", 50, 1, "shown")]


def test_state_goes_on_over_restarts(spark, tmp_path):
    """A count is kept between runs; a row behind the watermark is left out."""
    folder, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    t, schema = dt.datetime(2024, 1, 1), "event_id long, user_id string, ts timestamp_ntz"
    for batch in ([(1, "a", t), (2, "a", t + dt.timedelta(hours=1)), (8, "z", t + dt.timedelta(hours=2))], [(0, "a", t), (3, "a", t + dt.timedelta(hours=3)), (4, "a", t + dt.timedelta(hours=4)), (9, "z", t + dt.timedelta(hours=9))]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        read = spark.read.parquet(folder).schema
        stateful.drain(spark, lambda: stateful.suppress_repeats(telemetry.events(spark, folder, read), ["user_id"], shown=2), out, ck)
    got = spark.read.parquet(out).where("user_id = 'a'").collect()
    assert sorted((r.event_id, r.nth, r.state) for r in got) == [(1, 1, "shown"), (2, 2, "shown"), (3, 3, "suppressed")]


def test_filled_minutes_equal_batch(spark, replayed, tmp_path):
    folder, batch = replayed
    start, kinds = batch.agg(F.date_trunc("day", F.min("ts"))).first()[0], ["click", "error", "never"]
    got = run(spark, tmp_path, folder, batch.schema, lambda s: stateful.filled_timeline(s, "event_type", kinds, start, minutes=5))
    until = watermark(batch.where(F.col("event_type").isin(kinds)))
    until = until.replace(minute=until.minute // 5 * 5, second=0, microsecond=0)
    want = rollups.timeline(batch, "ts", "event_type", kinds, start, until, minutes=5).collect()
    assert len(got) == len(want) > 3 * 288
    assert {(r.bucket, r.event_type, r.n) for r in got} == {(r.bucket, r.event_type, r.n) for r in want}
    assert {r.n for r in got if r.event_type == "never"} == {0}
