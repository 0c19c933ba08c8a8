"""Skew-safe order plans equal the plain per-entity window."""

from pyspark.sql import functions as F

from metricspark.operators import features
from metricspark.plans.order import rolling_select, with_position
from metricspark.sources.tables import load_metrics

from conftest import SF01


def _rows(df, key="row_key"):
    return {r[key]: r for r in df.collect()}


def _assert_same(a, b, cols, key="row_key"):
    ra, rb = _rows(a, key), _rows(b, key)
    assert ra.keys() == rb.keys()
    for k in ra:
        for c in cols:
            x, y = ra[k][c], rb[k][c]
            assert (x is None and y is None) or abs(x - y) < 1e-9, (k, c, x, y)


def test_block_window_equals_plain_window(spark):
    m = load_metrics(spark, SF01).select("row_key", "host_id", "cpu_utilization", "memory_usage")
    cols = ["cpu_utilization", "memory_usage"]
    plain = features.rolling_features(m, ["host_id"], "row_key", cols, 3, bucket_widths=None)
    # tiny buckets force many bucket edges and both repair levels
    split = features.rolling_features(m, ["host_id"], "row_key", cols, 3, bucket_widths=(7, 97))
    out = [f"{c}_{s}" for c in cols for s in ("rolling_avg", "rolling_std", "lag1")]
    _assert_same(plain, split, out)


def test_moving_average_with_sparse_buckets(spark):
    m = load_metrics(spark, SF01).select("row_key", "host_id", "cpu_utilization")
    plain = features.moving_average(m, ["host_id"], "row_key", ["cpu_utilization"], 20, bucket_widths=None)
    split = features.moving_average(m, ["host_id"], "row_key", ["cpu_utilization"], 20, bucket_widths=(5, 50))
    _assert_same(plain, split, ["cpu_utilization_ma20"])


def test_hot_entity_split(spark):
    # one host holds a third of the rows: the split plan still equals the plain plan
    m = load_metrics(spark, SF01).withColumn(
        "host_id", F.when(F.col("row_key") % 3 == 0, F.lit(-1)).otherwise(F.col("host_id")))
    m = m.select("row_key", "host_id", "cpu_utilization")

    def make(w):
        return [f"avg(cpu_utilization) OVER ({w} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a",
                f"lag(cpu_utilization, 2) OVER ({w}) AS l2"]
    plain = rolling_select(m, ["host_id"], "row_key", make, 4, None)
    split = rolling_select(m, ["host_id"], "row_key", make, 4, (64, 4096))
    _assert_same(plain, split, ["a", "l2"])


def test_global_series_without_entity(spark):
    m = load_metrics(spark, SF01).select("row_key", "cpu_utilization")

    def make(w):
        return [f"avg(cpu_utilization) OVER ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a"]
    _assert_same(rolling_select(m, [], "row_key", make, 2, None),
                 rolling_select(m, [], "row_key", make, 2, (100, 1000)), ["a"])


def test_position_matches_row_number(spark):
    m = load_metrics(spark, SF01).select("row_key", "host_id")
    a = with_position(m, ["host_id"], "row_key", "pos", bucket_width=None)
    b = with_position(m, ["host_id"], "row_key", "pos", bucket_width=13)
    ra, rb = _rows(a), _rows(b)
    assert all(ra[k]["pos"] == rb[k]["pos"] for k in ra)
    assert min(r["pos"] for r in rb.values()) == 0


def test_no_single_partition_exchange(spark):
    m = load_metrics(spark, SF01).select("row_key", "host_id", "cpu_utilization")
    out = features.rolling_features(m, ["host_id"], "row_key", ["cpu_utilization"], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_fact_rows_shuffled_once(spark):
    m = load_metrics(spark, SF01).select("row_key", "host_id", "cpu_utilization")
    out = features.rolling_features(m, ["host_id"], "row_key", ["cpu_utilization"], 3, bucket_widths=(1024, 8192))
    out.collect()                                   # final adaptive plan
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan                  # edge branches read the same shuffle
    assert plan.count("FileScan parquet") == 1
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan   # pruned scan


def test_levels_that_do_not_split_are_dropped(spark):
    from metricspark.plans.order import splitting_widths
    m = load_metrics(spark, SF01)                    # row_key 0..9999
    assert splitting_widths(m, "row_key", (1 << 20, 1 << 30)) == []
    assert splitting_widths(m, "row_key", (1000, 1 << 20)) == [1000]


def test_all_rolling_columns_share_one_window(spark):
    # D1-D3 for every column: one Exchange, one Sort, one Window operator (plain plan)
    m = load_metrics(spark, SF01)
    cols = ["cpu_utilization", "memory_usage", "network_latency", "disk_io"]
    out = features.rolling_features(m.select("row_key", "host_id", *cols), ["host_id"], "row_key", cols, 3,
                                    bucket_widths=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("+- Sort ") + plan.count("-Sort ") == 1 or plan.count("Sort [") == 1
    assert plan.count("Window [") == 1
