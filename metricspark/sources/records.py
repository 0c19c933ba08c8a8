"""Row output as JSON records and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows_to_json(df: DataFrame, key_cols: Sequence[str] = ()) -> DataFrame:
    """``(keys..., record)``: one JSON object per row, NULL fields kept, timestamps as text."""
    cols = [F.col(f.name).cast("string").alias(f.name)
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*key_cols, F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))


def preview(df: DataFrame, order_cols: Sequence[str], n: int = 20, max_cols: int | None = None,
            digits: int | None = None) -> DataFrame:
    """First n rows; optionally the first ``max_cols`` columns with numbers rounded."""
    cols = df.columns[:max_cols] if max_cols else df.columns
    sel = []
    for c in cols:
        if digits is not None and isinstance(df.schema[c].dataType, T.NumericType):
            sel.append(F.round(F.col(c).cast("double"), digits).alias(c))
        else:
            sel.append(F.col(c))
    return df.orderBy(*order_cols).limit(n).select(*sel)
