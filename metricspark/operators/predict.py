"""Prediction analytics: errors in original units, forecast, labels, load levels, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import first_n_per_entity

# Load levels (fixed values): upper bounds, exclusive.
LOAD_LEVELS = [(40.0, "Low"), (60.0, "Medium"), (80.0, "High")]
LOAD_TOP = "Critical"
MAPE_EPS = 1e-9


def load_level(c: Column) -> Column:
    expr = F.lit(LOAD_TOP)
    for bound, name in reversed(LOAD_LEVELS):
        expr = F.when(c < bound, F.lit(name)).otherwise(expr)
    return expr


def combined_load(cpu: Column, memory: Column | None) -> Column:
    """(cpu + memory) / 2, or cpu alone when memory is absent / NULL."""
    if memory is None:
        return cpu
    return F.when(memory.isNull(), cpu).otherwise((cpu + memory) / 2.0)


def error_metrics(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE and MAPE (x100, epsilon in the denominator) in the units of the inputs."""
    a, p = F.col(actual), F.col(pred)
    aggs = [F.avg(F.abs(p - a)).alias("mae"),
            (F.avg(F.abs((a - p) / (F.abs(a) + F.lit(MAPE_EPS)))) * 100.0).alias("mape")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def regression_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R^2 in one pass: R^2 = 1 - SSE / SST with SST = n * var_pop(y), NULL for a constant label."""
    y, p = F.col(label), F.col(pred)
    e = p - y
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
            (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
            F.count(F.lit(1)).alias("n")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def slope_forecast(df: DataFrame, entity_cols: Sequence[str], order_col: str, value_col: str,
                   horizon: int = 20, recent: int = 6, lo: float = 0.0, hi: float = 100.0,
                   trend_band: float = 0.2) -> DataFrame:
    """Per entity: slope = mean successive difference of the last ``recent`` values
    (= (last - first) / (n - 1), 0 for one value); ``last + slope*i`` for i = 1..h,
    clipped to [lo, hi]; trend increasing / decreasing beyond +-band, else stable.
    The last ``recent`` rows per entity are taken with a descending row number
    (partial ``WindowGroupLimit`` before the shuffle)."""
    tail = first_n_per_entity(df.select(*entity_cols, order_col, value_col), entity_cols,
                              F.col(order_col).desc(), recent, name="__k", keep_rank=True)
    st = tail.groupBy(*entity_cols).agg(
        F.max_by(value_col, order_col).alias("last_value"),
        F.min_by(value_col, order_col).alias("first_value"),
        F.count(F.lit(1)).alias("n_recent"))
    slope = F.when(F.col("n_recent") > 1,
                   (F.col("last_value") - F.col("first_value")) / (F.col("n_recent") - 1)).otherwise(F.lit(0.0))
    trend = (F.when(F.col("slope") > trend_band, "increasing")
             .when(F.col("slope") < -trend_band, "decreasing").otherwise("stable"))
    st = st.select(*entity_cols, "last_value", slope.alias("slope")).withColumn("trend", trend)
    return st.select(*entity_cols, "slope", "trend", "last_value",
                     F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")).select(
        *entity_cols, "step",
        F.greatest(F.lit(lo), F.least(F.lit(hi), F.col("last_value") + F.col("slope") * F.col("step"))).alias("value"),
        "slope", "trend")


def time_labels(df: DataFrame, time_col: str | None, position_col: str) -> Column:
    """Timestamp text when a time column exists, else ``Interval i+1``."""
    if time_col and time_col in df.columns:
        return F.col(time_col).cast("string")
    return F.concat(F.lit("Interval "), (F.col(position_col) + 1).cast("string"))


def relative_time(ref: str, position: Column, n: int) -> Column:
    """``ref - (n - i)`` minutes for display position i (reference time is a parameter)."""
    return F.lit(ref).cast("timestamp_ntz") - F.make_dt_interval(
        F.lit(0), F.lit(0), (F.lit(n) - position).cast("int"), F.lit(0))


def level_distribution(df: DataFrame, level_col: str = "load_level") -> DataFrame:
    counts = df.groupBy(level_col).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(level_col, "count",
                         (F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy())).alias("share_pct"))
