"""CSV scan with pandas-like missing-value tokens and an explicit schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqlexpr import q

# Text read as missing (fixed values, the common pandas defaults used by the reference's inputs).
NULL_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "-NaN", "-nan", "n/a", "<NA>", "#N/A"]
CSV_GLOB = "*.[cC][sS][vV]"
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# Text of each type, in the order in which a column is tried; what fits none of them is text.  The patterns
# keep to what a CSV writer means by a number: the engine's own casts also take ``12d`` or a bare year.
_INT = r"^[+-]?[0-9]+$"
_DOUBLE = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"
_BOOL = r"^(?i:true|false)$"
LATTICE = [(T.LongType(), _INT), (T.DoubleType(), _DOUBLE), (T.TimestampNTZType(), _TIME), (T.BooleanType(), _BOOL)]


def _present(c: str, null_tokens: Sequence[str]):
    """The trimmed text of a column, NULL where it is a missing token."""
    t = F.trim(F.col(q(c)))
    return F.when(~t.isin(list(null_tokens)), t)


def infer_schema(text: DataFrame, null_tokens: Sequence[str] = NULL_TOKENS) -> T.StructType:
    """The narrowest type of LATTICE that takes every value of a text column, missing tokens aside; all missing
    is a double.  One aggregate over all rows: per column, the values and those that each type takes."""
    aggs = []
    for i, c in enumerate(text.columns):
        v = _present(c, null_tokens)
        aggs.append(F.count(v).alias(f"n{i}"))
        aggs += [F.count_if(v.rlike(p) & v.try_cast(t).isNotNull()).alias(f"n{i}_{k}") for k, (t, p) in enumerate(LATTICE)]
    got = text.agg(*aggs).first()
    fields = []
    for i, c in enumerate(text.columns):
        fits = [t for k, (t, _) in enumerate(LATTICE) if got[f"n{i}_{k}"] == got[f"n{i}"]]
        kind = T.DoubleType() if not got[f"n{i}"] else fits[0] if fits else T.StringType()
        fields.append(T.StructField(c, kind))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             null_tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Header CSV; only ``.csv`` files (case-insensitive).  Every field is read as
    text, missing tokens become NULL, then each column is ``try_cast`` to the
    schema type (unparseable -> NULL instead of failing the job).  Without a schema
    the types are found by ``infer_schema``, so ``NA`` does not make a number column text."""
    reader = spark.read.option("header", True).option("pathGlobFilter", CSV_GLOB)
    if schema is None:
        text = reader.csv(path)
        schema = infer_schema(text, null_tokens)
    else:
        text = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])).csv(path)
    return text.select(*[
        (F.when(_present(f.name, null_tokens).isNotNull(), F.col(q(f.name))) if isinstance(f.dataType, T.StringType)
         else _present(f.name, null_tokens).try_cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def write_csv(df: DataFrame, path: str, missing: str = "") -> None:
    (df.write.mode("error").option("header", True).option("timestampNTZFormat", TS_FORMAT)
     .option("timestampFormat", TS_FORMAT).option("nullValue", missing).csv(path))


def scan_first_n(spark: SparkSession, path: str, order_cols: Sequence[str], n: int | None,
                 schema: T.StructType | None = None) -> DataFrame:
    df = read_csv(spark, path, schema)
    return df.orderBy(*order_cols).limit(n) if n else df
