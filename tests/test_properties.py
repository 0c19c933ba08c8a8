"""Randomised property tests (hypothesis): exact plans equal brute force on random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from metricspark.operators import packing
from metricspark.plans.order import rolling_select

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(tasks=st.lists(st.tuples(st.integers(0, 2), st.integers(1, 5), st.integers(0, 30), st.integers(0, 40)),
                      min_size=1, max_size=40),
       slots=st.integers(1, 4), chunk=st.integers(1, 6))
def test_first_fit_random(spark, tasks, slots, chunk):
    rows = [(g, i, float(c), float(m), p) for i, (g, p, c, m) in enumerate(tasks)]
    df = spark.createDataFrame(rows, "group_id long, task_id long, cpu_req double, memory_req double, priority int")
    expect = {}
    for g in {r[0] for r in rows}:
        loads = [[0.0, 0.0] for _ in range(slots)]
        for r in sorted([r for r in rows if r[0] == g], key=lambda r: (-r[4], r[1])):
            expect[r[1]] = None
            for k, s in enumerate(loads):
                if s[0] + r[2] <= 80.0 and s[1] + r[3] <= 85.0:
                    s[0] += r[2]
                    s[1] += r[3]
                    expect[r[1]] = k
                    break
    got = {r.task_id: r.slot for r in packing.first_fit(df, slots=slots, chunk=chunk).collect()}
    assert got == expect


@SETTINGS
@given(vals=st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.floats(-100, 100))), min_size=1,
                     max_size=60),
       w1=st.integers(1, 9), lookback=st.integers(1, 4))
def test_split_window_random(spark, vals, w1, lookback):
    rows = [(i, h, v) for i, (h, v) in enumerate(vals)]
    df = spark.createDataFrame(rows, "row_key long, host_id long, v double")

    def make(w):
        return [f"avg(v) OVER ({w} ROWS BETWEEN {lookback} PRECEDING AND CURRENT ROW) AS a",
                f"count(v) OVER ({w} ROWS BETWEEN {lookback} PRECEDING AND CURRENT ROW) AS n",
                f"lag(v, {lookback}) OVER ({w}) AS l"]
    plain = {r.row_key: r for r in rolling_select(df, ["host_id"], "row_key", make, lookback, None).collect()}
    split = {r.row_key: r for r in rolling_select(df, ["host_id"], "row_key", make, lookback,
                                                  (w1, w1 * 7)).collect()}
    assert plain.keys() == split.keys()
    for k, r in plain.items():
        s = split[k]
        assert r.n == s.n and r.l == s.l
        assert (r.a is None and s.a is None) or abs(r.a - s.a) < 1e-9


@SETTINGS
@given(gaps=st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0, 500_000, 1_000_000, 4_999_999, 5_000_000,
                                                                    7_000_000])), min_size=1, max_size=50),
       chunk=st.integers(1, 8))
def test_suppression_random(spark, gaps, chunk):
    import datetime as dt

    from metricspark.operators import alerts
    base, t, rows = dt.datetime(2024, 1, 1), 0, []
    for i, (host, gap) in enumerate(gaps):
        t += gap
        rows.append((i, host, base + dt.timedelta(microseconds=t), "m", "msg", "c"))
    df = spark.createDataFrame(rows, "row_key long, host_id long, timestamp timestamp_ntz, metric string, "
                                     "message string, severity string")
    last, expect = {}, set()
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        us = (r[2] - base) // dt.timedelta(microseconds=1)
        if r[1] not in last or us - last[r[1]] >= 5_000_000:
            expect.add(r[0])
            last[r[1]] = us
    got = {r.row_key for r in alerts.suppress(df, chunk=chunk, bucket_widths=(3_000_000, 30_000_000)).collect()}
    assert got == expect
