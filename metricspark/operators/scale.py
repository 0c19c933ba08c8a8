"""Standard / min-max scaling and its inverse.

Fitting runs one aggregate job whose single row (mean and scale per column)
is kept on the driver, like an MLlib ``StandardScalerModel``; transform and
inverse are flat projections with those values as literals.
Standard scaling uses the *population* deviation, a constant column maps to
0 (scale 1).  ``ml.feature.StandardScaler`` uses the sample deviation and
``MinMaxScaler`` maps constants to 0.5, so both are written as expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns
from ..functions.stats import fit_row, lit_double

SKIP = ("status", "timestamp")
MINMAX_EPS = 1e-12


@dataclass
class ScalerModel:
    method: str
    cols: list[str]
    params: dict  # __mu_c/__sc_c (standard) or __mn_c/__sc_c (min-max)

    def p(self, name: str) -> Column:
        return lit_double(self.params.get(name))


def scale_stat_aggs(cols: Sequence[str], method: str, fill_mean: bool = False) -> list[Column]:
    """Aggregates of a scaler fit.  With ``fill_mean`` the statistics are those
    of the columns after NULLs are replaced by the mean (same pass)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        if method == "standard":
            var = F.var_pop(x)
            if fill_mean:
                var = var * F.count(x) / F.count(F.lit(1))
            sd = F.sqrt(var)
            aggs += [F.avg(x).alias(f"__mu_{c}"),
                     F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias(f"__sc_{c}")]
        elif method == "minmax":
            rng = F.max(x) - F.min(x)
            sc = F.lit(1.0) / F.when(rng == 0, F.lit(1.0)).otherwise(rng)
            aggs += [(-F.min(x) * sc).alias(f"__mn_{c}"), sc.alias(f"__sc_{c}")]
        else:
            raise ValueError(f"unknown scaling method {method!r}; use 'standard' or 'minmax'")
    return aggs


def fit_scaler(df: DataFrame, cols: Sequence[str] | None = None, method: str = "standard",
               roles: Sequence[str] = ()) -> ScalerModel:
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=set(SKIP) | set(roles))
    return ScalerModel(method, cols, fit_row(df, scale_stat_aggs(cols, method)))


def scaled(x: Column, c: str, model: ScalerModel) -> Column:
    x = x.cast("double")
    if model.method == "standard":
        return (x - model.p(f"__mu_{c}")) / model.p(f"__sc_{c}")
    return x * model.p(f"__sc_{c}") + model.p(f"__mn_{c}")


def unscaled(expr: Column, c: str, model: ScalerModel) -> Column:
    if model.method == "standard":
        return expr * model.p(f"__sc_{c}") + model.p(f"__mu_{c}")
    return (expr - model.p(f"__mn_{c}")) / (model.p(f"__sc_{c}") + F.lit(MINMAX_EPS))


def transform(df: DataFrame, model: ScalerModel) -> DataFrame:
    return df.select(*[scaled(F.col(c), c, model).alias(c) if c in model.cols else F.col(c) for c in df.columns])


def scale(df: DataFrame, method: str = "standard", cols: Sequence[str] | None = None,
          roles: Sequence[str] = ()) -> tuple[DataFrame, ScalerModel]:
    model = fit_scaler(df, cols, method, roles)
    return transform(df, model), model


def inverse_frame(df: DataFrame, model: ScalerModel | None, cols: Sequence[str] | None = None,
                  suffix: str = "") -> DataFrame:
    """Inverse of the listed columns; columns that were not scaled, absent names, or no
    fitted model pass through unchanged.  With ``suffix`` the restored values are added
    as new columns instead of replacing."""
    if model is None:
        return df
    cols = [c for c in (cols if cols is not None else model.cols) if c in df.columns and c in model.cols]
    if not cols:
        return df
    if suffix:
        return df.select(*df.columns, *[unscaled(F.col(c), c, model).alias(c + suffix) for c in cols])
    return df.select(*[unscaled(F.col(c), c, model).alias(c) if c in cols else F.col(c) for c in df.columns])


def inverse_values(df: DataFrame, model: ScalerModel | None, value_col: str, as_col: str,
                   out: str | None = None) -> DataFrame:
    """Inverse-transform an arbitrary column (e.g. predictions) with the statistics of ``as_col``."""
    out = out or value_col
    if model is None or as_col not in model.cols:
        return df.withColumn(out, F.col(value_col).cast("double"))
    keep = [c for c in df.columns if c != out]
    return df.select(*keep, unscaled(F.col(value_col), as_col, model).alias(out))
