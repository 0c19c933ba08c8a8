"""Distributed regression models (MLlib) for load prediction.

Kinds: ``linear`` (OLS, normal equations), ``random_forest`` (100 trees, all
features per split, seed 42) and ``gradient_boosting`` (100 rounds, step 0.1,
depth 3, seed 42).  Training data should be materialised once
(``checkpoint``) because every MLlib pass re-reads it.

A random forest of more than MANY_ROWS rows is fitted by ``histforest``: the same forest
with other random draws, and passes that cost far less a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import histforest
from .predict import regression_metrics

#: Rows up to which MLlib fits a random forest.
MANY_ROWS = 50_000

KINDS = ("linear", "random_forest", "gradient_boosting")


def make_regressor(kind: str, label: str, seed: int = 42, num_trees: int = 100, max_depth: int = 10,
                   gbt_iter: int = 100):
    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol=label, regParam=0.0, solver="normal")
    if kind == "random_forest":
        return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=num_trees,
                                     featureSubsetStrategy="all", maxDepth=max_depth, seed=seed)
    if kind == "gradient_boosting":
        return GBTRegressor(featuresCol="features", labelCol=label, maxIter=gbt_iter, stepSize=0.1,
                            maxDepth=3, seed=seed)
    raise ValueError(f"unknown model kind {kind!r}; use one of {KINDS}")


def fit(df: DataFrame, features: Sequence[str], label: str, kind: str = "linear", **kw) -> PipelineModel | histforest.HistForest:
    if kind == "random_forest" and df.count() > MANY_ROWS:
        return histforest.fit(df, features, label, kw.get("num_trees", 100), kw.get("max_depth", 10), seed=kw.get("seed", 42))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[assembler, make_regressor(kind, label, **kw)]).fit(df)


def predict(model: PipelineModel | histforest.HistForest, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    if isinstance(model, histforest.HistForest):
        return model.predict(df, keep)
    out = model.transform(df)
    return out.select(*keep, "prediction") if keep else out.drop("features")


def evaluate(model: PipelineModel | histforest.HistForest, df: DataFrame, label: str) -> DataFrame:
    """MAE, RMSE, R^2 (one aggregate)."""
    return regression_metrics(predict(model, df, [label]), label, "prediction")


def coefficients(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    lr = model.stages[-1]
    rows = [(i, f, float(c)) for i, (f, c) in enumerate(zip(features, lr.coefficients.toArray()))]
    rows.append((len(rows), "intercept", float(lr.intercept)))
    return SparkSession.getActiveSession().createDataFrame(rows, "ordinal int, term string, coefficient double")


def feature_importance(model: PipelineModel | histforest.HistForest, features: Sequence[str], top: int | None = 5) -> DataFrame:
    """Tree-model importances sorted descending (top n)."""
    forest = isinstance(model, histforest.HistForest)
    imp = model.importances() if forest else model.stages[-1].featureImportances.toArray()
    df = SparkSession.getActiveSession().createDataFrame(
        [(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), F.col("feature"))
    return df.limit(top) if top else df
