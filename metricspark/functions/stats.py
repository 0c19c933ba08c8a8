"""One-pass statistics and how they are applied to rows.

Global statistics follow the MLlib estimator pattern: one aggregate job
produces a single row (a handful of numbers per column, independent of the
data size), which is fetched and applied as literals.  This keeps every
downstream plan a flat projection instead of re-embedding the upstream plan
once per statistics pass.  Per-entity statistics (one row per entity) are
never fetched: they are joined on the entity key; AQE turns that join into a
broadcast only when the measured stats side is small and splits skewed
partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sqlexpr import dlit, q


def fit_row(df: DataFrame, aggs: list[Column]) -> dict:
    """Run one global aggregate (exactly one output row) and return it as a dict."""
    row = df.agg(*aggs).first()
    return row.asDict() if row is not None else {}


def lit_double(v) -> Column:
    return F.lit(None).cast("double") if v is None else F.lit(float(v))


def attach_stats(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    if not by:
        return df.crossJoin(F.broadcast(stats))      # exactly one row
    return df.join(stats, on=list(by), how="left")


def approx_quantiles(c: Column, ps: Sequence[float], accuracy: int = 10000) -> Column:
    """Array of approximate quantiles (Greenwald-Khanna sketch, bounded memory per group).
    Exact quantiles: ``functions.quantile.exact_quantiles`` / ``grouped_exact_quantiles``."""
    return F.percentile_approx(c, F.array(*[F.lit(float(p)) for p in ps]), accuracy)


class StatsRef:
    """Statistics either as literals (global fit) or as columns of a joined stats frame."""

    def __init__(self, values: dict | None):
        self.values = values

    def __call__(self, name: str) -> Column:
        if self.values is None:
            return F.col(name)
        return lit_double(self.values.get(name))

    def sql(self, name: str) -> str:
        if self.values is None:
            return q(name)
        return dlit(self.values.get(name))


def apply_stats(df: DataFrame, aggs: list[Column], by: Sequence[str] = ()) -> tuple[DataFrame, StatsRef]:
    """Global: fetch the one-row fit and reference it as literals.  Grouped: join per entity."""
    if not by:
        return df, StatsRef(fit_row(df, aggs))
    return attach_stats(df, df.groupBy(*by).agg(*aggs), by), StatsRef(None)


def salted_join(df: DataFrame, stats: DataFrame, keys: Sequence[str], salt_col: str, salts: int = 16) -> DataFrame:
    """Join fact rows to a small per-entity table so that one hot entity spreads over
    ``salts`` partitions: the small side is replicated once per salt, each fact row
    takes the salt given by a hash of ``salt_col`` (e.g. its unique row key)."""
    keys = list(keys)
    rep = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    fact = df.withColumn("__salt", F.pmod(F.xxhash64(F.col(salt_col)), F.lit(salts)).cast("int"))
    return fact.join(rep, [*keys, "__salt"], "inner").drop("__salt")
