"""Column roles and schema-driven column selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
# Model features: float64/float32/int64/int32 only.
MODEL_TYPES = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns in schema order, minus ``exclude`` (roles such as order/entity keys)."""
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


def model_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, MODEL_TYPES) and f.name not in ex]


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Keep the names that exist in ``df`` (optional-column semantics)."""
    names = set(df.columns)
    return [c for c in cols if c in names]


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Normalise NaN to NULL on fractional columns (Spark sorts NaN largest and averages it)."""
    frac = {f.name for f in df.schema.fields if isinstance(f.dataType, FRACTIONAL)}
    targets = set(cols) if cols is not None else frac
    return df.select(*[
        F.nanvl(F.col(c), F.lit(None).cast("double")).cast(df.schema[c].dataType).alias(c)
        if c in frac and c in targets else F.col(c)
        for c in df.columns
    ])
