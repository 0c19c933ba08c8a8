"""Ordinary least squares from one aggregate, with rank detection.

Each task sends the sums and products of its rows, shifted by the columns' means; their sum is the Gram
matrix of features and label, whatever the number of rows.  A pivoted Cholesky factorisation of the
correlations solves the normal equations: columns that the chosen ones determine (and constant
columns) are reported and get no weight, so collinear features do not make the system singular.

A fitted model is a plain expression: its weights are literals in a projection that reads only the
columns with a weight.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqlexpr import dcol, dlit, q
from ..functions.stats import fit_row
from ..session import ship_package

#: A column with less than this share of its variance left beside the chosen ones depends on them.
TOLERANCE = 1e-10
#: Pivots this close to the largest count as equal: the first in the order of the features is taken.
TIE = 1e-6


@dataclass
class LinearModel:
    features: list[str]
    label: str
    weights: dict[str, float]       # of the independent features
    intercept: float
    dependent: list[str]            # determined by the others, or constant
    n: int
    r2: float | None                # on the rows of the fit; None for a constant label

    def sql(self) -> str:
        """The prediction as SQL text."""
        return " + ".join([dlit(self.intercept), *[f"{dlit(w)} * {dcol(c)}" for c, w in self.weights.items()]])

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.selectExpr("*", f"{self.sql()} AS {q(name)}")

    def coefficients(self, spark) -> DataFrame:
        """One row per feature and the intercept; a dependent feature has weight 0."""
        rows = [(i, f, float(self.weights.get(f, 0.0)), f in self.dependent) for i, f in enumerate(self.features)]
        rows.append((len(rows), "intercept", float(self.intercept), False))
        return spark.createDataFrame(rows, "ordinal int, term string, coefficient double, dependent boolean")


def gram(df: DataFrame, cols: Sequence[str], shift: Sequence[float] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, centred products) of the rows that have a value in every column.  ``shift``: values
    near the means, which saves the pass that takes these."""
    ship_package(df.sparkSession)
    # One filtered projection serves both passes, so the shift fits the rows that are counted.
    x = df.selectExpr(*[f"{dcol(c)} AS {q(f'c{i}')}" for i, c in enumerate(cols)])
    x = x.where(" AND ".join(f"c{i} IS NOT NULL AND NOT isnan(c{i})" for i in range(len(cols))))
    if shift is None:
        row = fit_row(x, [F.avg(f"c{i}").alias(f"c{i}") for i in range(len(cols))])
        shift = [row[f"c{i}"] or 0.0 for i in range(len(cols))]
    means = np.array(shift)
    k = len(cols)

    def run(batches):
        n, total, products = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - means
            n, total, products = n + len(v), total + v.sum(axis=0), products + v.T @ v
        i, j = (a.astype(np.int32) for a in np.divmod(np.arange(k * k), k))
        yield pa.RecordBatch.from_pydict({"i": i, "j": j, "p": products.ravel(), "s": total[i],
                                          "n": np.full(k * k, n, np.int64)})

    parts = x.mapInArrow(run, "i int, j int, p double, s double, n long")
    got = parts.groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
    out, rest, n = np.zeros((k, k)), np.zeros(k), 0
    for i, j, p, s, m in zip(*(got.column(c).to_pylist() for c in ("i", "j", "p", "s", "n"))):
        out[i, j], rest[i], n = p, s, m
    if n:
        out -= np.outer(rest, rest) / n   # what the shift left
    return n, means + rest / max(n, 1), (out + out.T) / 2


def pivoted_cholesky(a: np.ndarray, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[int]]:
    """Factor and chosen columns of a correlation matrix: ``a[chosen][:, chosen] = l @ l.T``."""
    k = len(a)
    left, l, chosen = np.diag(a).copy(), np.zeros((k, k)), []
    while len(chosen) < k:
        rest = [c for c in range(k) if c not in chosen]
        top = max(left[c] for c in rest)
        if top <= tolerance:
            break
        p = next(c for c in rest if left[c] >= top * (1 - TIE))
        m = len(chosen)
        root = np.sqrt(left[p])
        l[:, m] = (a[:, p] - l[:, :m] @ l[p, :m]) / root
        l[chosen, m] = 0.0
        left -= l[:, m] ** 2
        chosen.append(p)
    return l[chosen][:, :len(chosen)], chosen


def solve(n: int, means: np.ndarray, products: np.ndarray, features: Sequence[str], label: str) -> LinearModel:
    """The model of a Gram matrix whose last column is the label.  Without rows all weights are dropped."""
    size = np.sqrt(np.diag(products))
    real = [i for i in range(len(features)) if size[i] > 0]
    scale = np.where(size > 0, size, 1.0)
    corr = products / np.outer(scale, scale)
    l, order = pivoted_cholesky(corr[np.ix_(real, real)]) if real else (np.zeros((0, 0)), [])
    chosen = [real[c] for c in order]
    y = len(features)
    z = np.linalg.solve(l, corr[chosen, y]) if chosen else np.zeros(0)
    b = np.linalg.solve(l.T, z) if chosen else z
    found = dict(zip(chosen, b * size[y] / scale[chosen]))
    weights = {features[i]: float(found[i]) for i in sorted(found)}
    intercept = float(means[y] - sum(found[i] * means[i] for i in found))
    r2 = float(min(1.0, z @ z)) if size[y] > 0 else None
    return LinearModel(list(features), label, weights, intercept,
                       [f for i, f in enumerate(features) if i not in found], n, r2)


def fit(df: DataFrame, features: Sequence[str], label: str) -> LinearModel:
    """Least squares with intercept.  Rows with a missing value in a feature or the label are left out;
    without rows, or with a constant label, there is no R^2."""
    return solve(*gram(df, [*features, label]), features, label)
