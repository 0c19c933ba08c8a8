"""Feature and forecast semantics against pandas / hand-computed expectations."""

import numpy as np
import pandas as pd
import pytest

from metricspark.operators import features, predict


def test_rolling_features_match_pandas(spark):
    vals = [1.0, None, 4.0, 2.0, None, None, 7.0, 3.0]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(vals)], "row_key long, host_id long, v double")
    out = features.rolling_features(df, ["host_id"], "row_key", ["v"], 3, bucket_widths=(2, 4))
    got = out.toPandas().sort_values("row_key").reset_index(drop=True)
    s = pd.Series(vals, dtype=float)
    exp_avg = s.rolling(3, min_periods=1).mean()
    exp_std = s.rolling(3, min_periods=1).std().fillna(0)
    exp_lag = s.shift(1).fillna(s)
    np.testing.assert_allclose(got["v_rolling_avg"].astype(float), exp_avg, equal_nan=True)
    np.testing.assert_allclose(got["v_rolling_std"].astype(float), exp_std, equal_nan=True)
    np.testing.assert_allclose(got["v_lag1"].astype(float), exp_lag, equal_nan=True)


def test_one_row_frame(spark):
    df = spark.createDataFrame([(1, 0, 5.0)], "row_key long, host_id long, v double")
    r = features.rolling_features(df, ["host_id"], "row_key", ["v"]).collect()[0]
    assert (r.v_rolling_avg, r.v_rolling_std, r.v_lag1) == (5.0, 0.0, 5.0)


def test_moving_average_needs_full_window(spark):
    vals = [float(i) for i in range(25)]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(vals)], "row_key long, host_id long, v double")
    got = features.moving_average(df, ["host_id"], "row_key", ["v"], 20).toPandas().sort_values("row_key")
    exp = pd.Series(vals).rolling(20).mean()
    np.testing.assert_allclose(got["v_ma20"].astype(float).to_numpy(), exp.to_numpy(), equal_nan=True)


def test_ratios_only_when_both_columns_exist(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0)], "row_key long, cpu_utilization double, memory_usage double")
    out = features.ratio_features(df)
    assert "cpu_memory_ratio" in out.columns and "io_latency_ratio" not in out.columns
    assert out.collect()[0].cpu_memory_ratio == pytest.approx(10.0 / 1e-9)


def test_forecast_clip_and_trend(spark):
    vals = [50.0, 60.0, 90.0, 92.0, 94.0, 96.0, 98.0, 100.0]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(vals)], "row_key long, host_id long, v double")
    fc = predict.slope_forecast(df, ["host_id"], "row_key", "v", horizon=20).orderBy("step").collect()
    assert len(fc) == 20 and fc[0].slope == pytest.approx(2.0)
    assert all(r.value == 100.0 for r in fc) and fc[0].trend == "increasing"


def test_forecast_single_point_and_empty(spark):
    one = spark.createDataFrame([(0, 0, 42.0)], "row_key long, host_id long, v double")
    fc = predict.slope_forecast(one, ["host_id"], "row_key", "v", horizon=3).collect()
    assert [r.value for r in fc] == [42.0] * 3 and fc[0].trend == "stable"
    empty = spark.createDataFrame([], "row_key long, host_id long, v double")
    assert predict.slope_forecast(empty, ["host_id"], "row_key", "v").count() == 0


def test_load_levels(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 40.0, 59.9, 60.0, 80.0, 95.0)], "x double")
    got = [r[0] for r in df.select(predict.load_level(df.x)).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "Critical", "Critical"]


def test_regression_metrics_formula(spark):
    rows = [(1.0, 1.5), (2.0, 1.0), (3.0, 3.5), (4.0, 4.0)]
    df = spark.createDataFrame(rows, "y double, p double")
    r = predict.regression_metrics(df, "y", "p").collect()[0]
    y, p = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    assert r.mae == pytest.approx(np.mean(np.abs(p - y)))
    assert r.rmse == pytest.approx(np.sqrt(np.mean((p - y) ** 2)))
    assert r.r2 == pytest.approx(1 - np.sum((p - y) ** 2) / np.sum((y - y.mean()) ** 2))


def test_feature_columns_keep_or_drop_target_derived(spark):
    from metricspark.plans.pipeline import preprocess
    from metricspark.sources.tables import load_metrics
    p = preprocess(load_metrics(spark, "/root/testdata/sf0.001"))
    keep = p.feature_columns("cpu_utilization")
    drop = p.feature_columns("cpu_utilization", drop_leaky=True)
    assert "cpu_utilization_lag1" in keep and "cpu_memory_ratio" in keep
    assert "cpu_utilization_lag1" not in drop and "cpu_memory_ratio" not in drop
    assert "cpu_utilization" not in keep and "status" not in keep and "row_key" not in keep
    assert "memory_usage_lag1" in drop


def _events(spark, path, n=400):
    """A hot host, a missing host, missing values."""
    spark.range(n).selectExpr(
        "id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id AS int)) AS ts",
        "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 1 ELSE id % 20 END AS user_id",
        "CASE WHEN id % 9 = 0 THEN 'error' ELSE 'view' END AS event_type",
        "CASE WHEN id % 31 = 0 THEN NULL ELSE cast((id * 7919) % 500 AS double) END AS value",
        "concat('{\"k\": ', (id * 31) % 90, '}') AS props").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_stored_features_give_the_same_rows_without_a_window(spark, tmp_path):
    from metricspark.plans.pipeline import STAT_COLUMNS, preprocess
    from metricspark.session import stored
    from metricspark.sources.tables import load_metrics
    m = load_metrics(spark, _events(spark, tmp_path))
    plain, kept = preprocess(m), preprocess(m, store=lambda df: stored(df, "test-features"))
    assert kept.df.columns == plain.df.columns and len(plain.scaler.cols) > STAT_COLUMNS
    assert kept.scaler.params == pytest.approx(plain.scaler.params, rel=1e-12)
    a, b = ([tuple(r) for r in p.df.drop("timestamp").orderBy("row_key").collect()] for p in (plain, kept))
    assert len(a) == 400 and all(x == pytest.approx(y, abs=1e-9) for x, y in zip(a, b, strict=True))
    plans = [p.df._jdf.queryExecution().executedPlan().toString() for p in (plain, kept)]
    assert "Window" in plans[0] and "Window" not in plans[1]


def test_training_rows_of_one_row_group_are_dealt_evenly(spark, tmp_path, monkeypatch):
    from metricspark.plans import queries
    d = _events(spark, tmp_path)
    few, _ = queries.training_frame(spark, d)
    made = []
    monkeypatch.setattr(queries, "stored", lambda df, name, f=queries.stored: (made.append((name, df.rdd.getNumPartitions())), f(df, name))[1])
    monkeypatch.setattr(queries.models, "MANY_ROWS", 100)
    many, _ = queries.training_frame(spark, d)
    assert made[0] == ("learning-metrics", 2 * spark.sparkContext.defaultParallelism) and made[1][0] == "training"
    a, b = ([tuple(r) for r in df.drop("timestamp").orderBy("row_key").collect()] for df in (few, many))
    assert len(a) == 400 and all(x[-1] == y[-1] and x[:-1] == pytest.approx(y[:-1], abs=1e-9) for x, y in zip(a, b, strict=True))
