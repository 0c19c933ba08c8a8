"""Buckets cut at measured splitters: even whatever the keys, and exact."""

import pytest
from pyspark.sql import functions as F

from metricspark.operators import features
from metricspark.plans import order
from metricspark.plans.order import RowBuckets, cut_by_rows, rolling_select, running_last, with_position

N = 12_000
KEYS = {  # order keys of N rows: by the minute, sparse 62-bit, bunched at one end, and dense
    "minutes": "timestamp_micros(60000000 * id + 1700000000000000)",
    "sparse": "abs(xxhash64(id)) >> 1",
    "bunched": "id * id * id",
    "dense": "id",
}


def frame(spark, key):
    """One host has two thirds of the rows, 40 others and a missing one share the rest."""
    host = "CASE WHEN id % 3 < 2 THEN 0 WHEN id % 1000 = 2 THEN NULL ELSE 1 + id % 40 END AS host"
    return spark.range(N).selectExpr(f"{KEYS[key]} AS t", host, "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 101 END AS v")


@pytest.mark.parametrize("key", KEYS)
def test_buckets_are_even(spark, key):
    df = frame(spark, key)
    cut = cut_by_rows(df, ["host"], "t", RowBuckets(500))
    sizes = {r[order._B]: r["count"] for r in cut.where("host = 0").groupBy(order._B).count().collect()}
    assert len(sizes) == 16 and max(sizes.values()) <= 2 * min(sizes.values())
    assert cut.where("host <> 0 OR host IS NULL").select(order._B).distinct().count() == 1
    # edges of three rows a side: the share of rows that a next level would look at
    assert 2 * 3 * sum(1 for _ in sizes) < 0.2 * sum(sizes.values())
    assert cut.count() == N and cut.columns == [*df.columns, order._B]


@pytest.mark.parametrize("key", KEYS)
@pytest.mark.parametrize("spec", [RowBuckets(500), RowBuckets(37), RowBuckets(10, 300)])
def test_windows_positions_and_last_values_equal_the_plain_ones(spark, key, spec):
    df = frame(spark, key)

    def make(w):
        return [f"sum(v) OVER ({w} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS s", f"lag(v, 3) OVER ({w}) AS l"]

    def rows(d):
        return sorted(d.collect(), key=repr)

    assert rows(rolling_select(df, ["host"], "t", make, 5, spec)) == rows(rolling_select(df, ["host"], "t", make, 5, None))
    assert rows(with_position(df, ["host"], "t", "p", spec)) == rows(with_position(df, ["host"], "t", "p", None))
    assert rows(running_last(df, ["host"], "t", "v", "r", spec)) == rows(running_last(df, ["host"], "t", "v", "r", None))


def test_no_entity_and_small_entities(spark):
    df = frame(spark, "sparse")
    a, b = (sorted(with_position(df, [], "t", "p", w).collect(), key=repr) for w in (RowBuckets(700), None))
    assert a == b
    assert cut_by_rows(df, ["host"], "t", RowBuckets(N)) is None
    assert cut_by_rows(df.limit(0), ["host"], "t", RowBuckets(1)) is None
    one = df.withColumn("t", F.lit(5).cast("long"))     # one key: one bucket
    assert cut_by_rows(one, ["host"], "t", RowBuckets(100)).select(order._B).distinct().count() == 2


def test_two_levels_of_splitters(spark, monkeypatch):
    monkeypatch.setattr(order, "SPLITTER_GROUP", 4)
    df = frame(spark, "bunched")
    cut = cut_by_rows(df, ["host"], "t", RowBuckets(100)).where("host = 0")
    sizes = cut.groupBy(order._B).agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).orderBy("lo").collect()
    assert len(sizes) >= 75 and max(r["n"] for r in sizes) <= 300
    assert all(a["hi"] < b["lo"] and a[order._B] < b[order._B] for a, b in zip(sizes, sizes[1:]))


def test_fact_rows_are_shuffled_once(spark):
    from metricspark.sources.tables import load_metrics

    from conftest import SF01
    m = load_metrics(spark, SF01).select("row_key", "host_id", "cpu_utilization")
    out = features.rolling_features(m, ["host_id"], "row_key", ["cpu_utilization"], 3, bucket_widths=RowBuckets(60))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("Exchange hashpartitioning(host_id#") <= 3
