"""Statistical anomaly detection and reports (isolation forest lives in ``iforest``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null
from ..functions.sqlexpr import dcol, dlit, q
from ..functions.stats import apply_stats, salted_join
from ..plans.order import first_n_per_entity

# Series anomaly rule (fixed values): |z| threshold, minimum deviation, explanation text.
SERIES_Z = 2.5
SERIES_MIN_STD = 1e-9
EXPLAIN_PREFIX, EXPLAIN_SUFFIX = "Spike detected due to sudden ", "."   # + "<name> <direction>"


def zscore_anomalies(df: DataFrame, cols: Sequence[str], z_threshold: float = 3.0,
                     by: Sequence[str] = ()) -> DataFrame:
    """Mean-fill, |z| with the population deviation of the filled column, flag if any
    |z| > t, score = max |z| over columns.  A constant column has no z and is skipped;
    NaN counts as missing."""
    df = nan_to_null(df, cols)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"__mu_{c}"),
                 F.sqrt(F.var_pop(x) * F.count(x) / F.count(F.lit(1))).alias(f"__sd_{c}")]
    j, st = apply_stats(df, aggs, by)
    zs = []
    for c in cols:
        mu, sd = st.sql(f"__mu_{c}"), st.sql(f"__sd_{c}")
        zs.append(f"abs((coalesce({dcol(c)}, {mu}) - {mu}) / nullif({sd}, 0D))")
    score = f"greatest({', '.join(zs)})" if len(zs) > 1 else zs[0]
    out = j.selectExpr(*[q(c) for c in df.columns], f"{score} AS anomaly_score")
    return out.selectExpr("*", f"coalesce(anomaly_score > {dlit(z_threshold)}, false) AS is_anomaly")


def top_anomalies(scored: DataFrame, order_col: str, n: int = 10, score_col: str = "anomaly_score",
                  flag_col: str = "is_anomaly") -> DataFrame:
    """Flagged rows by score desc, ties by order key (``TakeOrderedAndProject``)."""
    return scored.where(F.col(flag_col)).orderBy(F.col(score_col).desc(), F.col(order_col)).limit(n)


def series_anomalies(df: DataFrame, entity_cols: Sequence[str], value_col: str, name: str | None,
                     z: float = SERIES_Z, min_std: float = SERIES_MIN_STD,
                     extra_cols: Sequence[str] = (), salt_col: str | None = None,
                     rows_per_salt: int = 2_000_000, max_salts: int = 256) -> DataFrame:
    """Per entity: points with |z| > t (population stats), none when std < min_std.
    Adds direction (surge/drop vs the mean) and the explanation text.

    The per-entity statistics are a partial aggregate (materialised once, one row per
    entity).  With ``salt_col`` they are joined back salted: the largest entity's row
    count sets the number of salts (ceil(max / rows_per_salt)), so a hot entity's rows
    spread over that many partitions; one salt means a plain join."""
    stats = df.groupBy(*entity_cols).agg(F.avg(value_col).alias("__mu"), F.stddev_pop(value_col).alias("__sd"),
                                         F.count(F.lit(1)).alias("__n"))
    stats = stats.where(F.col("__sd") >= min_std)
    salts = 1
    if salt_col:
        stats = stats.checkpoint()
        biggest = stats.agg(F.max("__n")).first()[0] or 0
        salts = int(min(max_salts, max(1, -(-biggest // rows_per_salt))))
    stats = stats.drop("__n")
    if salts > 1:
        j = salted_join(df, stats, entity_cols, salt_col, salts)
    else:
        j = df.join(stats, list(entity_cols), "inner")
    zc = F.abs((F.col(value_col) - F.col("__mu")) / F.col("__sd"))
    hits = j.select(*entity_cols, *extra_cols, F.col(value_col).alias("value"), zc.alias("z_score"),
                    F.when(F.col(value_col) > F.col("__mu"), "surge").otherwise("drop").alias("direction"))
    hits = hits.where(F.col("z_score") > z)
    if name is None:            # caller builds the text (e.g. several metrics in long form)
        return hits
    return hits.withColumn("explanation", F.concat(
        F.lit(f"{EXPLAIN_PREFIX}{name} "), F.col("direction"), F.lit(EXPLAIN_SUFFIX)))


def split_samples(df: DataFrame, cols: Sequence[str], order_col: str, flag_col: str = "is_anomaly",
                  n: int = 100) -> DataFrame:
    """First n normal and first n anomalous values per metric (long form)."""
    long = df.select(order_col, flag_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("p")).select(order_col, flag_col, "p.*")
    return first_n_per_entity(long, ["column_name", flag_col], order_col, n)


def points_long(df: DataFrame, cols: Sequence[str], keep: Sequence[str], flag_col: str = "is_anomaly") -> DataFrame:
    return df.select(*keep, flag_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols
    ])).alias("p")).select(*keep, flag_col, "p.*")
