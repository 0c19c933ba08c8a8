"""Alerts, suppression, CSV scan and streams."""

import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricspark.operators import alerts
from metricspark.session import scratch_path
from metricspark.sources import csv as csvsrc

BASE = dt.datetime(2024, 1, 1)


def test_alerts_suppressed_within_5_seconds(spark):
    secs = [0, 3, 4.9, 5, 7, 10]
    rows = [(i, 1, BASE + dt.timedelta(seconds=s), "cpu_usage", "High CPU Usage: 90%", "critical")
            for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "row_key long, host_id long, timestamp timestamp_ntz, metric string, "
                                     "message string, severity string")
    kept = sorted(r.row_key for r in alerts.suppress(df).collect())
    assert [secs[k] for k in kept] == [0, 5, 10]


def test_threshold_alert_messages(spark):
    df = spark.createDataFrame([(1, 1, BASE, 86.5, None, 90.4)],
                               "row_key long, host_id long, timestamp timestamp_ntz, cpu_utilization double, "
                               "memory_usage double, network_latency double")
    feed = alerts.metric_feed(df)
    r = feed.collect()[0]
    assert r.memory_usage == 60.0          # default only for NULL
    msgs = sorted(a.message for a in alerts.threshold_alerts(feed).collect())
    assert msgs == ["High CPU Usage: 87%", "High Network Traffic: 90 Mbps"]


def test_zero_is_not_replaced_by_default(spark):
    df = spark.createDataFrame([(1, 0.0)], "row_key long, cpu_utilization double")
    assert alerts.metric_feed(df).collect()[0].cpu_usage == 0.0


def test_csv_null_tokens(spark):
    path = scratch_path(spark, "csv-nulls")
    os.makedirs(path)
    with open(os.path.join(path, "m.CSV"), "w") as f:
        f.write("row_key,cpu,name\n1,,a\n2,NA,b\n3,NaN,c\n4,null,d\n5,7.5,e\n6,oops,f\n")
    with open(os.path.join(path, "ignored.txt"), "w") as f:
        f.write("row_key,cpu,name\n99,1,z\n")
    schema = T.StructType([T.StructField("row_key", T.LongType()), T.StructField("cpu", T.DoubleType()),
                           T.StructField("name", T.StringType())])
    df = csvsrc.scan_first_n(spark, path, ["row_key"], 10, schema)
    rows = df.collect()
    assert [r.row_key for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [r.cpu for r in rows] == [None, None, None, None, 7.5, None]


def test_last_n_and_recent_lists(spark):
    df = spark.createDataFrame([(0, i) for i in range(100)], "host_id long, row_key long")
    out = alerts.newest_first(df, ["host_id"], [F.col("row_key").desc()], 60, 20)
    rows = out.collect()
    assert len(rows) == 60 and sum(r.shown for r in rows) == 20
    assert max(r.row_key for r in rows if r.rank == 1) == 99


def test_suppression_chunked_rounds_match_greedy(spark):
    import random
    random.seed(1)
    rows, t = [], 0.0
    for i in range(1500):
        t += random.choice([0.0, 0.7, 1.3, 2.9, 6.0])
        rows.append((i, i % 2, BASE + dt.timedelta(seconds=round(t, 6)), "x", "m", "c"))
    df = spark.createDataFrame(rows, "row_key long, host_id long, timestamp timestamp_ntz, metric string, "
                                     "message string, severity string")
    last, expect = {}, set()
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        us = int((r[2] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5)
        if r[1] not in last or us - last[r[1]] >= 5_000_000:
            expect.add(r[0])
            last[r[1]] = us
    got = {r.row_key for r in alerts.suppress(df, chunk=23, bucket_widths=(50_000_000, 5_000_000_000)).collect()}
    assert got == expect


def test_stream_twins_equal_batch(spark):
    from metricspark.plans import queries as Q
    sf = "/root/testdata/sf0.001"
    for stream, batch in (("stream_alert_suppression", "alert_suppression"), ("stream_last_60", "last_60_buffer")):
        s = Q.QUERIES[stream](spark, sf)
        a = sorted(tuple(r) for r in s.collect())
        b = sorted(tuple(r) for r in Q.QUERIES[batch](spark, sf).select(*s.columns).collect())
        assert a == b


def test_types_are_found_beside_missing_tokens(spark):
    path = scratch_path(spark, "csv-types")
    os.makedirs(path)
    with open(os.path.join(path, "m.csv"), "w") as f:
        f.write("i,d,t,b,s,none,long,code,mixed\n"
                "1,1.5,2024-01-02 03:04:05,true,x,NA,9223372036854775807,12d,2024-01-02\n"
                "NA,NA,null,NaN,NA,,1,7,3\n"
                " 7 ,1e3,2024-01-03,FALSE,2,NA,-5,8f,4\n")
    df = csvsrc.read_csv(spark, path)
    assert {f.name: f.dataType.simpleString() for f in df.schema.fields} == {
        "i": "bigint", "d": "double", "t": "timestamp_ntz", "b": "boolean", "s": "string", "none": "double",
        "long": "bigint", "code": "string", "mixed": "string"}
    rows = {r["long"]: r for r in df.collect()}
    assert [rows[k]["i"] for k in (2**63 - 1, 1, -5)] == [1, None, 7]
    assert rows[-5]["d"] == 1000.0 and rows[1]["s"] is None and rows[-5]["b"] is False
    with open(os.path.join(path, "big.csv"), "w") as f:
        f.write("i,d,t,b,s,none,long,code,mixed\n9223372036854775808,1,,,,,1,,\n")
    assert csvsrc.read_csv(spark, path).schema["i"].dataType == T.DoubleType()
