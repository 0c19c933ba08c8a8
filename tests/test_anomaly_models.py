"""Anomaly detection, isolation forest and MLlib models."""

import pytest
from pyspark.sql import functions as F

from metricspark.operators import anomaly, iforest, models, predict
from metricspark.plans.pipeline import preprocess
from metricspark.plans.queries import split_expr
from metricspark.sources.tables import load_metrics

from conftest import SF001, SF01


def test_constant_column_never_flags(spark):
    df = spark.createDataFrame([(i, 50.0) for i in range(50)], "row_key long, cpu double")
    out = anomaly.zscore_anomalies(df, ["cpu"])
    assert out.where("is_anomaly").count() == 0
    assert out.where(F.col("anomaly_score").isNotNull()).count() == 0


def test_zscore_flags_outlier_and_ties_by_key(spark):
    rows = [(i, 1.0) for i in range(100)] + [(200, 1000.0), (100, 1000.0)]
    df = spark.createDataFrame(rows, "row_key long, v double")
    top = anomaly.top_anomalies(anomaly.zscore_anomalies(df, ["v"]), "row_key", 2).collect()
    assert [r.row_key for r in top] == [100, 200]


def test_series_anomalies_none_for_flat_series(spark):
    df = spark.createDataFrame([(0, i, 5.0) for i in range(10)], "host_id long, row_key long, v double")
    assert anomaly.series_anomalies(df, ["host_id"], "v", "CPU usage").count() == 0


def test_isolation_forest_share_and_ranking(spark):
    m = load_metrics(spark, SF01)
    cols = ["cpu_utilization", "memory_usage", "network_latency", "power_consumption", "disk_io"]
    out = iforest.isolation_forest(m, cols, contamination=0.05, n_trees=50)
    n, flagged = out.count(), out.where("is_anomaly").count()
    assert abs(flagged / n - 0.05) < 0.01
    s = out.agg(F.min("anomaly_score"), F.max("anomaly_score")).collect()[0]
    assert 0.0 < s[0] < s[1] < 1.0
    # extreme latency rows score higher than the median row
    hi = out.where(F.col("network_latency") > 300).agg(F.avg("anomaly_score")).collect()[0][0]
    med = out.approxQuantile("anomaly_score", [0.5], 0.01)[0]
    assert hi > med


@pytest.mark.parametrize("n", [255, 20_000, 20_001, 30_000])
def test_isolation_forest_trees_have_full_samples(spark, n):
    df = spark.range(n).select(F.col("id").alias("row_key"), F.rand(3).alias("x"))
    nodes, info = iforest.fit_forest(df, ["x"], n_trees=100, psi=256)
    sizes = [r["size"] for r in nodes.where("node = 0").select("size").collect()]
    assert len(sizes) == 100 and set(sizes) == {min(256, n)} and info["psi"] == min(256, n)


def test_nan_constant_and_empty_input(spark):
    df = spark.createDataFrame([(k, float("nan") if k == 0 else float(k % 5)) for k in range(1000)], "row_key long, x double")
    assert anomaly.zscore_anomalies(df, ["x"], 3.0).where("is_anomaly").isEmpty()
    one = spark.createDataFrame([(1.0, 2.0)] * 3, "y double, p double")
    assert predict.regression_metrics(one, "y", "p").first().r2 is None
    assert predict.regression_metrics(one.limit(0), "y", "p").first().n == 0


def test_c_factor():
    assert iforest.c_factor(1) == 0.0 and iforest.c_factor(2) == 1.0
    assert iforest.c_factor(256) == pytest.approx(10.244770920116851, rel=1e-9)


def test_linear_model_recovers_plane(spark):
    rows = [(float(i), float(i % 7), 3.0 * i - 2.0 * (i % 7) + 5.0) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    m = models.fit(df, ["a", "b"], "y", "linear")
    coef = {r.term: r.coefficient for r in models.coefficients(m, ["a", "b"]).collect()}
    assert coef["a"] == pytest.approx(3.0) and coef["b"] == pytest.approx(-2.0)
    assert coef["intercept"] == pytest.approx(5.0)
    assert models.evaluate(m, df, "y").collect()[0].r2 == pytest.approx(1.0)


def test_tree_models_fit_and_rank_features(spark):
    p = preprocess(load_metrics(spark, SF001))
    df = p.df.withColumn("split", split_expr()).checkpoint()
    feats = p.feature_columns("cpu_utilization")
    tr, te = df.where("split = 'train'"), df.where("split = 'test'")
    rf = models.fit(tr, feats, "cpu_utilization", "random_forest", num_trees=10, max_depth=4)
    assert models.evaluate(rf, te, "cpu_utilization").collect()[0].r2 > 0.5
    top = models.feature_importance(rf, feats, 5).collect()
    assert len(top) == 5 and top[0].importance >= top[-1].importance
    gbt = models.fit(tr, feats, "cpu_utilization", "gradient_boosting", gbt_iter=5)
    assert models.evaluate(gbt, te, "cpu_utilization").collect()[0].rmse >= 0
    with pytest.raises(ValueError):
        models.make_regressor("svm", "y")


def test_salted_series_anomalies_equal_plain(spark):
    m = load_metrics(spark, SF01).withColumn(
        "host_id", F.when(F.col("row_key") % 3 == 0, F.lit(-1)).otherwise(F.col("host_id")))
    plain = anomaly.series_anomalies(m, ["host_id"], "network_latency", "latency", extra_cols=["row_key"])
    salted = anomaly.series_anomalies(m, ["host_id"], "network_latency", "latency", extra_cols=["row_key"],
                                      salt_col="row_key", rows_per_salt=500)   # hot host -> 7 salts
    key = lambda df: sorted((r.row_key, round(r.z_score, 9), r.explanation) for r in df.collect())
    assert key(plain) == key(salted) and len(key(plain)) > 0
