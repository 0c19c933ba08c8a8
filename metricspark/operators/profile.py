"""Profiling / EDA: every report is one aggregate pass (plots are not drawn, their data is)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numeric_columns, present
from ..functions.quantile import exact_quantiles
from ..functions.stats import approx_quantiles, lit_double

# Default histogram columns (fixed values).
DEFAULT_HIST_COLUMNS = ["cpu_utilization", "memory_usage", "network_latency", "power_consumption"]


def schema_report(df: DataFrame) -> DataFrame:
    """Rows ``(ordinal, column_name, data_type, n_rows, n_columns)``; one count pass."""
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "ordinal int, column_name string, data_type string",
    )
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return meta.crossJoin(F.broadcast(n)).withColumn("n_columns", F.lit(len(df.columns)))


def profile_missing(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing (NULL) count per column plus the total over columns, in long form."""
    cols = list(cols) if cols is not None else list(df.columns)
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)])
    total = sum((F.col(f"m{i}") for i in range(len(cols))), F.lit(0))
    return agg.select(
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
                     F.col(f"m{i}").alias("n_missing"))
            for i, c in enumerate(cols)
        ])).alias("m"),
        total.cast("long").alias("total_missing"),
    ).select("m.*", "total_missing")


def profile_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier identical row (NULLs equal): sum(count-1) over groups.
    Group-by with partial aggregation: a hot duplicate group is combined map-side."""
    cols = list(cols) if cols is not None else list(df.columns)
    groups = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.sum(F.col("n") - 1).cast("long").alias("n_duplicates"),
    ).fillna(0)


def profile_describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation), max per numeric column."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mu{i}"), F.stddev_samp(x).alias(f"sd{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if not exact:
            aggs.append(approx_quantiles(x, [0.25, 0.5, 0.75]).alias(f"q{i}"))
    one = df.agg(*aggs)
    if exact:   # exact quantiles by distributed selection, attached as literals
        qv = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
        one = one.select("*", *[F.array(*[lit_double(qv[(c, p)]) for p in (0.25, 0.5, 0.75)]).alias(f"q{i}")
                                for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"),
            F.col(f"n{i}").alias("count"), F.col(f"mu{i}").alias("mean"), F.col(f"sd{i}").alias("std"),
            F.col(f"lo{i}").alias("min"), F.col(f"q{i}")[0].alias("p25"), F.col(f"q{i}")[1].alias("p50"),
            F.col(f"q{i}")[2].alias("p75"), F.col(f"hi{i}").alias("max"))
        for i, c in enumerate(cols)
    ])).alias("d")).select("d.*")


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30) -> DataFrame:
    """Equal-width histogram over [min, max] per column, last bin closed, NULLs dropped,
    empty bins reported with 0.  A constant column uses [v-0.5, v+0.5]."""
    cols = present(df, cols if cols is not None else DEFAULT_HIST_COLUMNS)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols
    ])).alias("p")).select("p.*").where(F.col("v").isNotNull())
    rng = long.groupBy("column_name").agg(F.min("v").alias("vmin"), F.max("v").alias("vmax"))
    rng = rng.select(
        "column_name",
        F.when(F.col("vmin") == F.col("vmax"), F.col("vmin") - 0.5).otherwise(F.col("vmin")).alias("lo"),
        F.when(F.col("vmin") == F.col("vmax"), F.col("vmax") + 0.5).otherwise(F.col("vmax")).alias("hi"),
    )
    # At most len(cols) rows: a proven broadcast bound.
    binned = long.join(F.broadcast(rng), "column_name").select(
        "column_name",
        F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))),
                F.lit(bins - 1)).cast("int").alias("bin"),
    ).groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = rng.select("column_name", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    w = (F.col("hi") - F.col("lo")) / bins
    return grid.join(binned, ["column_name", "bin"], "left").select(
        "column_name", "bin",
        (F.col("lo") + F.col("bin") * w).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation for every ordered column pair (pairwise-complete rows), long form.
    One aggregate with m(m+1)/2 ``corr`` buffers; mirrored pairs reuse the same value."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    aggs, names = [], {}
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            names[(i, j)] = f"c{i}_{j}"
            aggs.append(F.corr(F.col(a).cast("double"), F.col(cols[j]).cast("double")).alias(names[(i, j)]))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.col(names[(min(i, j), max(i, j))]).alias("corr"))
        for i, a in enumerate(cols) for j, b in enumerate(cols)
    ])).alias("p")).select("p.*")


# Insights (fixed values): name, column, aggregate.
INSIGHTS = [
    ("high_cpu", "cpu_utilization", F.max),
    ("avg_memory", "memory_usage", F.avg),
    ("high_latency", "network_latency", F.max),
    ("avg_power", "power_consumption", F.avg),
]


def insights(df: DataFrame) -> DataFrame:
    """(insight, value); absent columns and NULL results are left out."""
    items = [(n, fn(F.col(c).cast("double"))) for n, c, fn in INSIGHTS if c in df.columns]
    if not items:
        return df.sparkSession.createDataFrame([], "insight string, value double")
    one = df.agg(*[e.alias(n) for n, e in items])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("insight"), F.col(n).alias("value")) for n, _ in items
    ])).alias("i")).select("i.*").where(F.col("value").isNotNull())


def uptime_range(df: DataFrame, col: str = "uptime") -> DataFrame:
    if col not in df.columns:
        return df.sparkSession.createDataFrame([], "uptime_min double, uptime_max double")
    return df.agg(F.min(F.col(col)).cast("double").alias("uptime_min"),
                  F.max(F.col(col)).cast("double").alias("uptime_max"))


def first_rows(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """First n rows in order (``TakeOrderedAndProject``: top-n per task, then merge)."""
    return df.orderBy(*order_cols).limit(n)


def eda_summary(df: DataFrame, max_samples: int | None = None, order_cols: Sequence[str] = ("row_key",),
                exclude_dup: Sequence[str] = ()) -> DataFrame:
    """EDA headline on the first ``max_samples`` rows: shape, missing, duplicates, insights."""
    sample = first_rows(df, order_cols, max_samples) if max_samples else df
    cols = list(df.columns)
    ins = {n: fn(F.col(c).cast("double")).alias(n) for n, c, fn in INSIGHTS if c in cols}
    base = sample.agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0)).cast("long").alias("total_missing"),
        *ins.values(),
    ).withColumn("n_columns", F.lit(len(cols)))
    dup_cols = [c for c in cols if c not in set(exclude_dup)]
    dups = profile_duplicates(sample, dup_cols).select("n_duplicates")
    return base.crossJoin(dups)
