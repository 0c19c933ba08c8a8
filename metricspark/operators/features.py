"""Order-dependent feature engineering: rolling mean/std, lag, moving average, ratios.

All rolling columns of one call share one window specification, so Spark
plans a single Exchange + Sort + Window for all of them; the skew-safe
``rolling_select`` plan splits hot entities by order-key range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import numeric_columns, present
from ..functions.sqlexpr import dcol, dlit, q
from ..plans.order import DEFAULT_BUCKET_WIDTHS, rolling_select

# Ratio features (fixed values): output name, numerator, denominator.
RATIOS = [
    ("cpu_memory_ratio", "cpu_utilization", "memory_usage"),
    ("io_latency_ratio", "disk_io", "network_latency"),
    ("thread_process_ratio", "thread_count", "process_count"),
]
RATIO_EPS = 1e-9


def _rolling_exprs(cols, window):
    def make(w):
        frame = f"({w} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
        out = []
        for c in cols:
            x = dcol(c)
            out.append(f"avg({x}) OVER {frame} AS {q(c + '_rolling_avg')}")
            # pandas: fewer than two values -> NaN -> filled with 0.
            out.append(f"coalesce(stddev_samp({x}) OVER {frame}, 0D) AS {q(c + '_rolling_std')}")
        for c in cols:
            # First row, or a NULL previous value, falls back to the row's own value.
            out.append(f"coalesce(lag({q(c)}, 1) OVER ({w}), {q(c)}) AS {q(c + '_lag1')}")
        return out
    return make


def rolling_features(df: DataFrame, entity_cols: Sequence[str], order_col: str,
                     cols: Sequence[str], window: int = 3,
                     bucket_widths=DEFAULT_BUCKET_WIDTHS) -> DataFrame:
    """Adds ``{c}_rolling_avg``, ``{c}_rolling_std`` (pairs, in column order) then ``{c}_lag1``."""
    return rolling_select(df, entity_cols, order_col, _rolling_exprs(list(cols), window),
                          lookback=max(window - 1, 1), bucket_widths=bucket_widths)


def moving_average(df: DataFrame, entity_cols: Sequence[str], order_col: str,
                   cols: Sequence[str] = ("cpu_utilization", "memory_usage", "power_consumption"),
                   n: int = 20, bucket_widths=DEFAULT_BUCKET_WIDTHS) -> DataFrame:
    """``{c}_ma{n}``: mean of the last n rows, NULL until the frame holds n non-NULL values."""
    cols = present(df, cols)

    def make(w):
        frame = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return [f"CASE WHEN count({q(c)}) OVER {frame} = {n} THEN avg({dcol(c)}) OVER {frame} END "
                f"AS {q(f'{c}_ma{n}')}" for c in cols]
    return rolling_select(df, entity_cols, order_col, make, lookback=n - 1, bucket_widths=bucket_widths)


def ratio_features(df: DataFrame, eps: float = RATIO_EPS) -> DataFrame:
    """a / (b + eps) for each known pair whose two columns exist."""
    names = set(df.columns)
    extra = [f"{dcol(a)} / ({dcol(b)} + {dlit(eps)}) AS {q(n)}" for n, a, b in RATIOS if a in names and b in names]
    return df.selectExpr("*", *extra)


def engineer_features(df: DataFrame, entity_cols: Sequence[str], order_col: str,
                      cols: Sequence[str] | None = None, exclude: Sequence[str] = ("status",),
                      roles: Sequence[str] = (), window: int = 3,
                      bucket_widths=DEFAULT_BUCKET_WIDTHS) -> DataFrame:
    """Rolling avg/std pairs, lags, then ratios (column order of the reference pipeline)."""
    roles = set(roles) | set(entity_cols) | {order_col}
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=roles | set(exclude))
    out = rolling_features(df, entity_cols, order_col, cols, window, bucket_widths)
    return ratio_features(out)
