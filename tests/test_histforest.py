"""Random forests over binned blocks."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from metricspark.operators import histforest, models

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Some rows twice, a feature of few values."""
    df = spark.range(3000).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"), (F.col("id") % 4).alias("c"))
    df = df.withColumn("y", F.sin(6 * F.col("a")) + F.col("b") * F.col("c") + 0.1 * F.rand(3))
    return df.unionByName(df.where("id < 200")).checkpoint()


def test_tree_of_all_rows_equals_mllib(spark, rows, monkeypatch):
    monkeypatch.setattr(histforest, "BLOCK_ROWS", 150)
    ours = histforest.fit(rows, X, "y", trees=1, depth=6, bootstrap=False)
    x = VectorAssembler(inputCols=X, outputCol="features", handleInvalid="keep").transform(rows)
    mllib = RandomForestRegressor(labelCol="y", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=6).fit(x)
    odd = rows.withColumn("b", F.when(F.col("id") % 11 > 0, F.col("b")))   # missing values can be predicted
    x = VectorAssembler(inputCols=X, outputCol="features", handleInvalid="keep").transform(odd)
    a = {r.id: r.prediction for r in ours.predict(odd, ["id"]).collect()}
    b = {r.id: r.prediction for r in mllib.transform(x).select("id", "prediction").collect()}
    assert len(set(b.values())) > 40 and a == pytest.approx(b, abs=1e-8)
    assert ours.importances() == pytest.approx(mllib.featureImportances.toArray(), abs=1e-6)


def test_forest_of_many_rows_is_fitted_over_blocks(spark, rows, monkeypatch):
    mllib = models.fit(rows, X, "y", "random_forest", num_trees=20, max_depth=6)
    monkeypatch.setattr(models, "MANY_ROWS", 1000)
    ours, again = (models.fit(rows, X, "y", "random_forest", num_trees=20, max_depth=6) for _ in range(2))
    assert isinstance(ours, histforest.HistForest) and len(ours.trees) == 20
    one, two = (models.predict(m, rows, ["id", "y"]).orderBy("id").toPandas() for m in (ours, again))
    assert one.equals(two) and len(one) == rows.count()
    assert list(models.predict(ours, rows).columns) == [*rows.columns, "prediction"]
    r2 = [models.evaluate(m, rows, "y").first().r2 for m in (mllib, ours)]
    assert r2[1] == pytest.approx(r2[0], abs=0.01)
    shares = [[r.importance for r in models.feature_importance(m, X, None).orderBy("feature").collect()] for m in (mllib, ours)]
    assert shares[1] == pytest.approx(shares[0], abs=0.03) and sum(shares[1]) == pytest.approx(1.0)


def test_draws_are_poisson_and_differ_by_tree():
    w = [histforest.drawn(42, 7, t, 50_000) for t in (0, 1)]
    assert (w[0] != w[1]).any() and (w[0] == histforest.drawn(42, 7, 0, 50_000)).all()
    assert w[0].mean() == pytest.approx(1, abs=0.03) and w[0].var() == pytest.approx(1, abs=0.05)


def test_cuts_lie_between_values():
    assert histforest.cuts(np.array([2.0, 1.0, np.nan, 1.0])).tolist() == [1.5]
    assert not len(histforest.cuts(np.full(5, 3.0))) and not len(histforest.cuts(np.full(5, np.nan)))
    many = histforest.cuts(np.arange(1000.0))
    assert len(many) == 31 and np.diff(many) == pytest.approx(np.full(30, 1000 / 32), abs=1)


def test_constant_and_missing_values(spark):
    same = spark.range(50).select(F.col("id").alias("a"), F.lit(4.5).alias("y"))
    m = histforest.fit(same, ["a"], "y", trees=3, depth=3)
    assert {r.prediction for r in m.predict(same, ["a"]).collect()} == {4.5} and not m.importances().any()
    with pytest.raises(ValueError):
        histforest.fit(same.withColumn("y", F.when(F.col("a") > 0, 1.0)), ["a"], "y", trees=1)
    with pytest.raises(ValueError):
        histforest.fit(same.limit(0), ["a"], "y", trees=1)
    with pytest.raises(Exception, match="a feature is missing"):
        histforest.fit(same.withColumn("a", F.when(F.col("a") > 0, 1.0)), ["a"], "y", trees=1)
