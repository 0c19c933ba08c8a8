"""Streams over a folder of Parquet files: batch twins, restarts, replayed batches, bounded state."""

import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from metricspark.operators import alerts
from metricspark.plans import queries as Q
from metricspark.session import scratch_path
from metricspark.sources.tables import metrics_from_events, table
from metricspark.streaming import feeds

from conftest import SF001

PARTS = 4


@pytest.fixture()
def source(spark):
    """The events in time order, a file a quarter; ``add(k)`` puts quarter k there."""
    events = table(spark, SF001, "events")
    path = scratch_path(spark, "t-events")
    bounds = events.approxQuantile("event_id", [k / PARTS for k in range(PARTS + 1)], 0.0)

    def add(k):
        part = events.where((F.col("event_id") >= bounds[k] if k else F.lit(True))
                            & (F.col("event_id") < bounds[k + 1] if k < PARTS - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(path)
    return path, add, events


def rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


FEEDS = {
    "feed": (feeds.metric_feed_stream, "metric_feed"),
    "alerts": (feeds.suppressed_alerts_stream, "alert_suppression"),
    "last": (feeds.last_n_stream, "last_60_buffer"),
}


@pytest.mark.parametrize("name", FEEDS)
def test_a_restarted_stream_goes_on_and_equals_its_batch_twin(spark, source, name):
    stream, twin = FEEDS[name]
    path, add, _ = source
    place = feeds.Place.fresh(spark, "t-place")
    add(0)
    add(1)
    stream(spark, path, place)
    before = len(os.listdir(place.checkpoint.removeprefix("file:") + "/commits"))
    add(2)
    add(3)
    got = stream(spark, path, place)
    want = Q.QUERIES[twin](spark, SF001)
    assert rows(got, got.columns) == rows(want, got.columns)
    assert len(os.listdir(place.checkpoint.removeprefix("file:") + "/commits")) > before
    again = stream(spark, path, place)     # nothing new: nothing changes
    assert rows(again, got.columns) == rows(want, got.columns)


@pytest.mark.parametrize("name", FEEDS)
def test_a_replayed_batch_changes_nothing(spark, source, name):
    stream, _ = FEEDS[name]
    path, add, _ = source
    for k in range(PARTS):
        add(k)
    place = feeds.Place.fresh(spark, "t-place")
    want = rows(got := stream(spark, path, place), got.columns)
    commits = place.checkpoint.removeprefix("file:") + "/commits"
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    os.rename(f"{commits}/{last}", f"{commits}/../was-{last}")    # as if it had failed before the commit
    crc = f"{commits}/.{last}.crc"
    if os.path.exists(crc):
        os.rename(crc, f"{commits}/../was-{last}.crc")
    assert rows(stream(spark, path, place), got.columns) == want


def test_lists_hold_at_most_n_rows(spark, source):
    path, add, _ = source
    for k in range(PARTS):
        add(k)
    place = feeds.Place.fresh(spark, "t-place")
    feeds.last_n_stream(spark, path, place, n=7, show=3)
    sizes = spark.read.parquet(place.sink).groupBy("batch", "host_id").count().agg(F.max("count")).first()[0]
    assert sizes == 7


def test_suppression_across_files_and_rows_out_of_order(spark):
    """Kept alerts at 0, 5 and 10 s, whatever the order of rows in a file, and across files."""
    path, place = scratch_path(spark, "t-events"), feeds.Place.fresh(spark, "t-place")
    base = dt.datetime(2024, 1, 1)
    for part in ([4.9, 0, 3], [7, 5], [10, 9.999]):
        made = [(int(s * 1000), base + dt.timedelta(seconds=s), 1, "x", 500.0, '{"k": 1}') for s in part]
        spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
                                    "props string").coalesce(1).write.mode("append").parquet(path)
        got = feeds.suppressed_alerts_stream(spark, path, place)
    kept = {r.row_key for r in got.where("metric = 'network_traffic'").collect()}
    assert kept == {0, 5000, 10000}
    batch = alerts.suppress(alerts.threshold_alerts(alerts.metric_feed(metrics_from_events(spark.read.parquet(path)))))
    assert {r.row_key for r in batch.where("metric = 'network_traffic'").collect()} == kept


def test_processors_reach_workers_that_cannot_import_the_package(tmp_path):
    """The package is on the driver's path only."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (f"import sys; sys.path.insert(0, {root!r})\n"
              "from metricspark.session import local_session\n"
              "from metricspark.plans import queries as Q\n"
              "spark = local_session(2, 2)\n"
              f"print('rows', Q.QUERIES['stream_alert_suppression'](spark, {SF001!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 325" in out.stdout, out.stderr[-2000:]


def test_a_shard_holds_the_times_of_all_its_keys():
    """Many keys cost one read and one write of the shard's list; passed windows are dropped, others stay."""
    class Held:
        rows, calls = [], 0
        def exists(self): self.calls += 1; return bool(self.rows)
        def get(self): self.calls += 1; return iter(self.rows)
        def put(self, rows): self.calls += 1; self.rows = rows
        def clear(self): self.calls += 1; self.rows = []

    class Handle:
        held, timers = Held(), []
        def getListState(self, *_): return self.held
        def registerTimer(self, ms): self.timers.append(ms)

    class Mark:
        ms = 0
        def getCurrentWatermarkInMs(self): return self.ms

    def alert(k, host, us):
        return dict(row_key=k, host_id=host, timestamp=us, metric="m", message="x", severity="s", us=us)

    p, handle, mark = feeds.Suppression(5_000_000), Handle(), Mark()
    p.init(handle)
    first = [alert(k, k % 500, (k // 500) * 3_000_000) for k in range(1500)]      # each host at 0, 3 and 6 s
    got = sorted(r.row_key for r in p.handleInputRows((0,), iter(first[::-1]), mark))
    assert got == [*range(500), *range(1000, 1500)]
    assert handle.held.calls < 5 and len(handle.timers) == 1 and len(handle.held.rows) == 500
    later = [alert(2000, 0, 10_999_999), alert(2001, 1, 11_000_000), alert(2002, None, 11_000_000)]
    assert sorted(r.row_key for r in p.handleInputRows((0,), iter(later), mark)) == [2001, 2002]
    mark.ms = 11_500                                                                # the first ones' windows end at 11 s
    assert not list(p.handleExpiredTimer((0,), mark, None))
    assert sorted(handle.held.rows, key=str) == [(1, "x", 11_000_000), (None, "x", 11_000_000)]
