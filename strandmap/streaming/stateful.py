"""State with timers: the first rows of repeated errors, and intervals without events.

Both release rows once the watermark has passed them, in their order, so a
replay in any number of batches gives what the batch form gives for all rows
up to the watermark. State goes by event time, not by a clock's time to live,
as a replay would otherwise depend on how fast it runs. The state store has to
be ``spark.sql.streaming.stateStore.providerClass`` = RocksDB: see ``drain``.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strandmap.session import ship

#: The store that state with timers needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a released frame at most.
SLICE = 100_000


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts))


class _Repeats(StatefulProcessor):
    """Numbers a key's rows in the order of (us, id); a key waits with no more rows than it may still release."""

    def __init__(self, keys: list[str], id_type: str, shown: int, periodic: bool):
        self._keys, self._id_type, self._most, self._periodic = keys, id_type, shown + 1, periodic

    def init(self, handle) -> None:
        self._handle = handle
        self._released = handle.getValueState("released", "n long")
        self._waiting = handle.getListState("waiting", f"us long, id {self._id_type}")

    def _count(self) -> int:
        return int(self._released.get()[0]) if self._released.exists() else 0

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        room = self._most - self._count()
        kept = [(int(us), i) for us, i in self._waiting.get()] if self._waiting.exists() else []
        for frame in rows:
            # Smaller rows only push a row further back, so one beyond the room is never released.
            kept = heapq.nsmallest(room, chain(kept, zip(frame["us"].tolist(), frame["id"].tolist())))
        if kept:
            self._waiting.put(kept)
            for at in {-(-us // 1000) for us, _ in kept}:
                self._handle.registerTimer(at)
        if self._periodic:
            self._handle.registerTimer(int(key[-1]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = sorted((int(us), i) for us, i in self._waiting.get()) if self._waiting.exists() else []
        due = [row for row in kept if row[0] <= passed]
        if due:
            before = self._count()
            self._released.update((before + len(due),))
            rest = kept[len(due) :]
            if rest:
                self._waiting.put(rest)
            else:
                self._waiting.clear()
            nth = np.arange(before + 1, before + len(due) + 1, dtype=np.int32)
            columns = {name: [value] * len(due) for name, value in zip(self._keys, key)}
            yield pd.DataFrame(columns | {"us": [us for us, _ in due], "id": [i for _, i in due], "nth": nth})
        if self._periodic and int(key[-1]) * 1000 <= passed:  # nothing of this period can come any more
            self._released.clear()
            self._waiting.clear()

    def close(self) -> None:
        pass


def suppress_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", id: str = "event_id", shown: int = 8, late: str = "10 minutes", period: str | None = None) -> DataFrame:
    """(keys, id, ts, nth, state): the first ``shown`` rows of a key as shown, the next as suppressed; later ones go.

    Rows are numbered by (ts, id) as ``operators.ranking.suppress_repeats``
    numbers them, whatever the order of their arrival, and come out when the
    watermark passes them. Rows behind the watermark are left out. With a
    ``period`` ("1 day") each period counts anew, column period_end tells them
    apart, and a period's state is cleared when it is over; without one a key's
    count is kept for good. Rows with a null ts or id are left out; a null in a
    key is a key of its own.
    """
    ship(stream.sparkSession)
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    rows = stream.where(F.col(ts).isNotNull() & F.col(id).isNotNull()).withWatermark(ts, late)
    columns = [*map(F.col, keys), F.col(ts), _micros(ts).alias("us"), F.col(id).alias("id")]
    by = list(keys)
    if period:
        columns.append((F.unix_micros(F.window(ts, period).end) / 1000).cast("long").alias("period_end"))
        by.append("period_end")
    schema = ", ".join([*(f"`{k}` {kinds[k].simpleString()}" for k in keys), *(["period_end long"] if period else []), "us long", f"id {kinds[id].simpleString()}", "nth int"])
    processor = _Repeats(by, kinds[id].simpleString(), shown, period is not None)
    out = rows.select(*columns).groupBy(*by).transformWithStateInPandas(processor, schema, "append", "EventTime")
    ends = [F.timestamp_millis("period_end").alias("period_end")] if period else []
    return out.select(*keys, *ends, F.col("id").alias(id), F.timestamp_micros("us").alias(ts), "nth", F.when(F.col("nth") <= shown, "shown").otherwise("suppressed").alias("state"))


class _Fill(StatefulProcessor):
    """Hands on a kind's intervals without a gap; an interval is due when the watermark has passed its end."""

    def __init__(self, kind: str, width: int):
        self._kind, self._width = kind, width

    def init(self, handle) -> None:
        self._handle = handle
        self._next = handle.getValueState("next", "us long")
        self._counts = handle.getMapState("counts", "us long", "n long")

    def _wait(self, start: int) -> None:
        self._next.update((start,))
        self._handle.registerTimer(-(-(start + self._width) // 1000))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._wait(int(initialState["us"].iloc[0]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for us, n in zip(frame["us"].tolist(), frame["n"].tolist()):
                self._counts.updateValue((us,), (n,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        first = int(self._next.get()[0])
        end = first + max(0, (passed - first) // self._width) * self._width
        counts = {int(k[0]): int(v[0]) for k, v in self._counts.iterator()} if self._counts.exists() else {}
        for begin in range(first, end, self._width * SLICE):
            us = np.arange(begin, min(end, begin + self._width * SLICE), self._width)
            yield pd.DataFrame({self._kind: [key[0]] * len(us), "us": us, "n": [counts.get(u, 0) for u in us.tolist()]})
        for us in counts:
            if us < end:
                self._counts.removeKey((us,))
        self._wait(end)

    def close(self) -> None:
        pass


def filled_timeline(stream: DataFrame, kind: str, kinds: list[str], start, ts: str = "ts", minutes: int = 1, late: str = "10 minutes") -> DataFrame:
    """(bucket, kind, n) for every interval from ``start`` on and every given kind, zeros included.

    Events are counted by interval first, with partial sums, so that a frequent
    kind hands on one row an interval; kinds then wait with the intervals that
    are not due yet. Intervals come out, in order, as the watermark passes their
    end, also those of kinds without any event. ``start`` is the begin of an
    interval, without a zone in the session's; events before it are left out.
    """
    spark = stream.sparkSession
    ship(spark)
    begin = F.lit(start).cast("timestamp")
    rows = stream.where((F.col(ts) >= begin) & F.col(kind).isin(kinds)).withWatermark(ts, late)
    counted = rows.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), kind).agg(F.count("*").alias("n"))
    flat = counted.select(kind, "n", F.unix_micros("w.start").alias("us"), F.window_time("w").alias("_at"))
    text = stream.schema[kind].dataType.simpleString()
    heads = spark.createDataFrame([(k,) for k in dict.fromkeys(kinds)], f"`{kind}` {text}").withColumn("us", F.unix_micros(begin))
    filled = flat.groupBy(kind).transformWithStateInPandas(_Fill(kind, minutes * 60_000_000), f"`{kind}` {text}, us long, n long", "append", "EventTime", initialState=heads.groupBy(kind))
    return filled.select(F.timestamp_micros("us").alias("bucket"), kind, "n")


def drain(spark: SparkSession, stream: Callable[[], DataFrame], path: str, checkpoint: str) -> None:
    """Run a stream over all that its source holds now, into Parquet; a second run goes on from the checkpoint.

    The session's state store is RocksDB while the query starts, and what it
    was before afterwards: a started query keeps its own.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        running = stream().writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    running.awaitTermination()
