"""Structured Streaming forms of the live-metric operators.

The source is a table's own Parquet files, a bounded number of new files a micro-batch.  Every query takes
its sink and checkpoint as paths, so a query that is started again with the same paths goes on where it
stopped.

* ``metric_feed_stream`` – dashboard records, stateless, into Spark's exactly-once file sink.
* ``suppressed_alerts_stream`` – threshold alerts; a stateful processor holds the time of the last kept alert
  of every (host, message) in the list state of the key's shard, and event-time timers remove those whose
  suppression window the watermark has passed, so state is bounded by the keys of the last seconds.
* ``last_n_stream`` – the newest n records per host in list state of at most n rows; every micro-batch
  writes the lists that it changed to a folder of its own number, so a replayed batch changes nothing.
"""

from __future__ import annotations

import heapq
import sys
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import alerts
from ..session import scratch_path
from ..sources.tables import metrics_from_events


# A stateful processor also starts in a Python process of the driver that does not see shipped packages, so
# this module's classes travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Place:
    """Where a stream writes and where it remembers how far it has read."""

    sink: str
    checkpoint: str

    @staticmethod
    def fresh(spark: SparkSession, name: str) -> "Place":
        """New folders in the session's shared folder."""
        sink = scratch_path(spark, name)
        return Place(sink, sink + "-checkpoint")


def events_stream(spark: SparkSession, source: str, files: int = 1) -> DataFrame:
    """The metrics of an ``events`` table, at most ``files`` of its files a micro-batch.

    A table may be a folder or a single file; as a stream's source Spark takes the latter by a pattern only,
    so the path's last letter is written as one."""
    source = source.rstrip("/")
    schema = spark.read.parquet(source).schema
    pattern = f"{source[:-1]}[{source[-1]}]"
    return metrics_from_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern))


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _finished(spark: SparkSession, writer, place: Place) -> None:
    """Read all that is there by now, then stop.  Stateful processors need Spark's RocksDB state store: it is
    set while the query starts, which keeps it for its own lifetime."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = writer.option("checkpointLocation", place.checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
    query.awaitTermination()


def _written(df: DataFrame, place: Place) -> DataFrame:
    _finished(df.sparkSession, df.writeStream.format("parquet").outputMode("append").option("path", place.sink), place)
    return df.sparkSession.read.schema(df.schema).parquet(place.sink)


def metric_feed_stream(spark: SparkSession, source: str, place: Place, files: int = 1) -> DataFrame:
    return _written(alerts.metric_feed(events_stream(spark, source, files)), place)


class Suppression(StatefulProcessor):
    """Alerts of one shard of the keys (host, message): of a key's alerts one is kept unless a kept one is less
    than ``window_us`` older.  The state is the shard's list of keys with the time of their last kept alert, so a
    micro-batch costs a few state calls a shard, however many keys it has."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "host_id long, message string, us long")

    def held(self) -> dict:
        return {(r[0], r[1]): r[2] for r in self.last.get()} if self.last.exists() else {}

    def hold(self, last: dict, timerValues) -> None:
        """Keep the times whose window the watermark has not passed."""
        mark = timerValues.getCurrentWatermarkInMs()
        live = [(*key, us) for key, us in last.items() if (us + self.window_us) // 1000 >= mark]
        if live:
            self.last.put(live)
        else:
            self.last.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last, by_key, newest = self.held(), {}, None
        for r in rows:
            by_key.setdefault((r["host_id"], r["message"]), []).append(r)
        for each, found in by_key.items():
            found.sort(key=lambda r: (r["us"], r["row_key"]))
            times = [r["us"] for r in found]
            # From one kept alert straight to the first one that it does not suppress.
            k = bisect_left(times, last[each] + self.window_us) if each in last else 0
            while k < len(times):
                last[each] = times[k]
                newest = times[k] if newest is None else max(newest, times[k])
                yield Row(**{c: found[k][c] for c in ALERT_COLUMNS})
                k = bisect_left(times, times[k] + self.window_us, k + 1)
        if newest is not None:
            self.hold(last, timerValues)
            self.handle.registerTimer((newest + self.window_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Later alerts may have been kept since; their own timer is still to come.
        self.hold(self.held(), timerValues)
        return iter([])


ALERT_COLUMNS = ["row_key", "host_id", "timestamp", "metric", "message", "severity"]
#: Keys are dealt to so many shards, each with a state of its own.
SUPPRESSION_SHARDS = 1024
ALERT_SCHEMA = ("row_key long, host_id long, timestamp timestamp_ntz, metric string, message string, "
                "severity string")


def suppressed_alerts_stream(spark: SparkSession, source: str, place: Place, files: int = 1,
                             window_s: float = alerts.SUPPRESS_SECONDS, watermark: str = "10 seconds") -> DataFrame:
    """Exact where files come in the order of event time (rows inside a micro-batch in any order); alerts
    behind the watermark are dropped."""
    al = alerts.threshold_alerts(alerts.metric_feed(events_stream(spark, source, files)))
    al = al.withColumn("us", alerts.epoch_micros(F.col("timestamp"))).withColumn(
        "event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", watermark)
    al = al.withColumn("shard", F.pmod(F.xxhash64("host_id", "message"), F.lit(SUPPRESSION_SHARDS)))
    kept = al.groupBy("shard").transformWithState(
        Suppression(int(window_s * 1_000_000)), ALERT_SCHEMA, "Append", "EventTime")
    return _written(kept, place)


class Newest(StatefulProcessor):
    """The ``n`` rows of one key with the largest row_key; emits the whole list when it changes."""

    def __init__(self, n: int, columns: list[str], schema: str):
        self.n, self.columns, self.schema = n, columns, schema

    def init(self, handle) -> None:
        self.rows = handle.getListState("newest", self.schema)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        fresh = (tuple(r[c] for c in self.columns) for r in rows)
        newest = heapq.nlargest(self.n, {*held, *heapq.nlargest(self.n, fresh)})
        self.rows.put(newest)
        for rank, r in enumerate(newest, 1):
            yield Row(host_id=key[0], rank=rank, **dict(zip(self.columns, r)))


LAST_COLUMNS = ["row_key", "cpu_usage", "memory_usage", "network_traffic"]
LAST_SCHEMA = "row_key long, cpu_usage double, memory_usage double, network_traffic double"


def last_n_stream(spark: SparkSession, source: str, place: Place, files: int = 1, n: int = 60, show: int = 20) -> DataFrame:
    """The newest ``n`` records per host, ``shown`` telling of the first ``show``."""
    feed = alerts.metric_feed(events_stream(spark, source, files)).select("host_id", *LAST_COLUMNS)
    lists = feed.groupBy("host_id").transformWithState(
        Newest(n, LAST_COLUMNS, LAST_SCHEMA), f"host_id long, rank int, {LAST_SCHEMA}", "Update", "None")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place.sink}/batch={batch_id}")

    _finished(spark, lists.writeStream.outputMode("update").foreachBatch(per_batch), place)
    return newest_lists(spark, place.sink, show)


def newest_lists(spark: SparkSession, sink: str, show: int) -> DataFrame:
    """Each host's list as of the last micro-batch that changed it."""
    schema = f"host_id long, rank int, {LAST_SCHEMA}, batch long"
    rows = spark.read.schema(schema).parquet(sink)
    last = rows.groupBy("host_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["host_id", "batch"]).select(
        "host_id", "row_key", "rank", "cpu_usage", "memory_usage", "network_traffic", (F.col("rank") <= show).alias("shown"))
