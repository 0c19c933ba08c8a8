"""Cleaning: imputation, row drop, IQR winsorising, z-score replacement.

Each statistic is computed in one aggregate pass over all columns and
attached to the rows by a broadcast one-row cross join (or per entity with
``by``), so the result stays one lazy plan without ``collect``.  NaN counts as missing in every
operator, so a single one does not turn a mean into NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, numeric_columns
from ..functions.sqlexpr import dcol, dlit, q
from ..functions.quantile import exact_quantiles, grouped_exact_quantiles
from ..functions.stats import StatsRef, apply_stats, approx_quantiles, fit_row


def _value_cols(df: DataFrame, cols: Sequence[str] | None, roles: Sequence[str]) -> list[str]:
    return list(cols) if cols is not None else numeric_columns(df, exclude=roles)


def _replace_sql(df: DataFrame, out_cols: Sequence[str], exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{exprs[c]} AS {q(c)}" if c in exprs else q(c) for c in out_cols])


def _grouped_quantile_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str], ps: Sequence[float],
                            names: Sequence[str]) -> DataFrame:
    """Per-group exact quantiles (distributed selection) named ``{names[j]}{col}``."""
    q = grouped_exact_quantiles(df, by, cols, ps)
    return q.select(*by, *[F.col(f"q_{i}_{j}").alias(f"{names[j]}{c}") for i, c in enumerate(cols)
                           for j in range(len(ps))])


def impute_mean_with_counts(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, int]]:
    """Mean fill plus the non-NULL count of every filled column (the row count, or 0 for an
    all-NULL column) from the same aggregate pass."""
    df = nan_to_null(df, cols)
    aggs = [F.avg(F.col(c).cast("double")).alias(f"__f_{c}") for c in cols] + [F.count(F.lit(1)).alias("__n")]
    j, st = apply_stats(df, aggs, ())
    n = int(st.values["__n"] or 0)
    counts = {c: (n if st.values[f"__f_{c}"] is not None else 0) for c in cols}
    out = j.selectExpr(*[f"coalesce({dcol(c)}, {st.sql(f'__f_{c}')}) AS {q(c)}" if c in cols else q(c)
                         for c in df.columns])
    return out, counts


def impute(df: DataFrame, method: str = "mean", cols: Sequence[str] | None = None,
           roles: Sequence[str] = (), by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Fill NULLs of numeric columns with the column mean / median, or drop rows with any NULL.

    ``mean``/``median`` fill every numeric column except ``roles`` (order and
    entity keys); filled columns become double; strings are untouched; an
    all-NULL column stays NULL.  ``drop`` removes rows with a NULL in any column.
    """
    if method == "drop":
        return df.na.drop(how="any")
    if method not in ("mean", "median"):
        raise ValueError(f"unknown imputation method {method!r}; use 'mean', 'median' or 'drop'")
    cols = _value_cols(df, cols, roles)
    if not cols:
        return df
    df = nan_to_null(df, cols)
    if method == "median" and exact and not by:
        med = exact_quantiles(df, cols, [0.5])
        j, st = df, StatsRef({f"__f_{c}": med[(c, 0.5)] for c in cols})
    elif method == "median" and exact:
        j, st = df.join(_grouped_quantile_stats(df, by, cols, [0.5], ["__f_"]), list(by), "left"), StatsRef(None)
    else:
        if method == "mean":
            aggs = [F.avg(F.col(c).cast("double")).alias(f"__f_{c}") for c in cols]
        else:
            aggs = [approx_quantiles(F.col(c).cast("double"), [0.5])[0].alias(f"__f_{c}") for c in cols]
        j, st = apply_stats(df, aggs, by)
    return j.selectExpr(*[f"coalesce({dcol(c)}, {st.sql(f'__f_{c}')}) AS {q(c)}" if c in cols else q(c)
                          for c in df.columns])


def clip_iqr(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 1.5,
             roles: Sequence[str] = (), by: Sequence[str] = (), exact: bool = True,
             known_counts: dict[str, int] | None = None) -> DataFrame:
    """Winsorise each numeric column to [Q1 - t*IQR, Q3 + t*IQR]; rows are kept, NULLs stay NULL."""
    cols = _value_cols(df, cols, roles)
    if not cols:
        return df
    df = nan_to_null(df, cols)
    if exact and not by:
        qv = exact_quantiles(df, cols, [0.25, 0.75], known_counts=known_counts)
        j, st = df, StatsRef({f"__q{k}_{c}": qv[(c, p)] for c in cols for k, p in ((1, 0.25), (3, 0.75))})
    elif exact:
        qs = _grouped_quantile_stats(df, by, cols, [0.25, 0.75], ["__q1_", "__q3_"])
        j, st = df.join(qs, list(by), "left"), StatsRef(None)
    else:
        aggs = []
        for c in cols:
            qs = approx_quantiles(F.col(c).cast("double"), [0.25, 0.75])
            aggs += [qs[0].alias(f"__q1_{c}"), qs[1].alias(f"__q3_{c}")]
        j, st = apply_stats(df, aggs, by)
    t = dlit(threshold)
    exprs = {}
    for c in cols:
        q1, q3 = st.sql(f"__q1_{c}"), st.sql(f"__q3_{c}")
        lo, hi = f"({q1} - {t} * ({q3} - {q1}))", f"({q3} + {t} * ({q3} - {q1}))"
        exprs[c] = f"CASE WHEN {q(c)} IS NOT NULL THEN greatest({lo}, least({hi}, {dcol(c)})) END"
    return _replace_sql(j, df.columns, exprs)


def replace_zscore(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 3.0,
                   roles: Sequence[str] = (), by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Where |z| > t (population std) replace the value with the column median.
    A constant column has no z and is left as is; NULLs stay NULL."""
    cols = _value_cols(df, cols, roles)
    if not cols:
        return df
    df = nan_to_null(df, cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"__mu_{c}"), F.stddev_pop(x).alias(f"__sd_{c}")]
        if not exact:
            aggs.append(approx_quantiles(x, [0.5])[0].alias(f"__md_{c}"))
    if exact and not by:
        vals = fit_row(df, aggs)
        med = exact_quantiles(df, cols, [0.5])
        vals.update({f"__md_{c}": med[(c, 0.5)] for c in cols})
        j, st = df, StatsRef(vals)
    elif exact:
        stats = df.groupBy(*by).agg(*aggs).join(_grouped_quantile_stats(df, by, cols, [0.5], ["__md_"]),
                                                 list(by), "left")
        j, st = df.join(stats, list(by), "left"), StatsRef(None)
    else:
        j, st = apply_stats(df, aggs, by)
    exprs = {}
    for c in cols:
        z = f"abs(({dcol(c)} - {st.sql(f'__mu_{c}')}) / nullif({st.sql(f'__sd_{c}')}, 0D))"
        exprs[c] = f"CASE WHEN {z} > {dlit(threshold)} THEN {st.sql(f'__md_{c}')} ELSE {dcol(c)} END"
    return _replace_sql(j, df.columns, exprs)


def handle_outliers(df: DataFrame, method: str = "iqr", threshold: float = 1.5, **kw) -> DataFrame:
    if method == "iqr":
        return clip_iqr(df, threshold=threshold, **kw)
    if method == "zscore":
        return replace_zscore(df, threshold=threshold, **kw)
    raise ValueError(f"unknown outlier method {method!r}; use 'iqr' or 'zscore'")
