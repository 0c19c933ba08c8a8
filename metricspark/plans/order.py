"""Order-dependent plans that stay exact and skew-safe.

The reference treats a table as one ordered series.  Here every
order-dependent operator names an order key and optional entity columns.
A plain ``Window.partitionBy(entity)`` sends all rows of one host to one
task; if one host holds a third of all rows that task sorts a third of the
data.  The plans below split each entity into ranges of the order key
("buckets") and repair the bucket edges exactly:

* ``rolling_select`` – rolling frames that read at most ``lookback``
  preceding rows (rolling avg/std/count, lag).  Rows whose frame lies
  inside their bucket are final after one window over (entity, bucket).
  Only the first and last ``lookback`` rows of every bucket ("heads" and
  "tails") are recomputed: a head's frame consists of earlier heads of its
  own bucket and tails of earlier buckets, so a window over heads+tails is
  exact for heads.  That smaller set is processed the same way with wider
  buckets, until a plain per-entity window over a tiny set remains.
* ``with_position`` – exact 0-based position within the entity: counts per
  (entity, bucket), prefix sums over that small table, plus a row number
  inside the bucket.

By default the buckets are cut at measured splitters (``RowBuckets``): quantiles of an entity's own order
keys, so a bucket holds about the same number of rows whatever the keys are (timestamps by the minute,
sparse 62-bit ids).  Only entities with more rows than a bucket are measured and cut; without one the
plan is the plain window.  Fixed widths of key ranges can be given instead.  With ``bucket_widths=None``
everything falls back to the plain window (one sort), which is what the oracle SQL states.  Key-range levels
whose bucket covers the whole observed range are dropped after a one-column min/max check.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sqlexpr import q



@dataclass(frozen=True)
class RowBuckets:
    """Buckets of about ``rows`` rows of one entity; an entity has at most ``most`` of them."""

    rows: int = 1 << 20
    most: int = 1 << 16


DEFAULT_BUCKET_WIDTHS = RowBuckets()
# Splitters in a group: a row looks through the groups' first ones, then through one group.
SPLITTER_GROUP = 256

_B = "__bkt"
_RN = "__rn"
_CNT = "__cnt"


def _lead_field(df: DataFrame, order_col: str) -> tuple[str, T.DataType]:
    """A struct order key (e.g. (time, id)) is cut into ranges by its first field."""
    dt = df.schema[order_col].dataType
    if isinstance(dt, T.StructType):
        f = dt.fields[0]
        return f"{order_col}.{f.name}", f.dataType
    return order_col, dt


def order_number(df: DataFrame, order_col: str) -> Column:
    """Integer image of the order key used to cut key ranges."""
    name, dt = _lead_field(df, order_col)
    c = F.col(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("long")
    return c.cast("long")


def bucket_of(df: DataFrame, order_col: str, width: int) -> Column:
    return F.floor(order_number(df, order_col) / F.lit(width)).cast("long")


def entity_window(entity_cols: Sequence[str], order_col: str) -> WindowSpec:
    w = Window.partitionBy(*entity_cols) if entity_cols else Window.partitionBy()
    return w.orderBy(order_col)


def cut_by_rows(df: DataFrame, entity_cols: Sequence[str], order_col: str, spec: RowBuckets) -> DataFrame | None:
    """``df`` with its bucket, or None where no entity has more rows than a bucket.

    Two aggregates: rows per entity, and the quantile sketches of the entities that are cut.  These are fewer
    than all rows / ``spec.rows``, as are all splitters together, so both are broadcast.  Rows of one order
    key are in one bucket."""
    names = [f"__e{i}" for i in range(len(entity_cols))]
    key = order_number(df, order_col)
    slim = df.select(*[F.col(c).alias(n) for c, n in zip(entity_cols, names)], key.alias("__key"))
    counts = slim.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > spec.rows)
    # rows of the largest entity: how finely its keys are measured
    largest = counts.agg(F.max("__n")).first()[0]
    if largest is None:
        return None
    parts = min(spec.most, -(-largest // spec.rows))

    def same(left, right):
        """Equal entities, a missing one equal to a missing one; columns go by their names."""
        out = F.lit(True)
        for a, b in zip(left, right):
            out = out & F.col(q(a)).eqNullSafe(F.col(b))
        return out

    big = [f"__b{i}" for i in range(len(names))]
    measured = slim.join(F.broadcast(counts.select(*[F.col(n).alias(b) for n, b in zip(names, big)], "__n")), same(names, big))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    step = F.greatest(F.lit(1), F.floor(F.lit(parts) * spec.rows / F.first("__n")).cast("int"))
    cuts = measured.groupBy(*big).agg(F.percentile_approx("__key", shares, F.lit(max(10_000, 10 * parts))).alias("__q"),
                                      step.alias("__step"))
    some = F.array_distinct(F.filter("__q", lambda x, i: (i + 1) % F.col("__step") == 0))
    cuts = cuts.select(*big, some.alias("__q")).where(F.size("__q") > 0).select(*big, F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__q") - 1) / SPLITTER_GROUP).cast("int")),
        lambda g: F.slice("__q", g * SPLITTER_GROUP + 1, SPLITTER_GROUP)).alias("__groups"))
    # A key equal to a splitter goes behind it; groups begin with their least splitter.
    group = F.size(F.filter("__groups", lambda g: g[0] <= key))
    inside = F.size(F.filter(F.element_at("__groups", group), lambda x: x <= key))
    bucket = F.when(group > 0, (group - 1) * SPLITTER_GROUP + inside).otherwise(0).cast("long")
    return df.join(F.broadcast(cuts), same(entity_cols, big), "left").select(
        *[F.col(q(c)) for c in df.columns], F.coalesce(bucket, F.lit(0)).alias(_B))


def first_level(widths) -> "RowBuckets | int | None":
    """What plans with one level take from the widths of plans with several."""
    if isinstance(widths, RowBuckets) or widths is None:
        return widths
    return widths[0] if widths else None


def bucketed(df: DataFrame, entity_cols: Sequence[str], order_col: str, width) -> DataFrame | None:
    """``df`` with its bucket by rows or by key range, or None where one bucket would hold all."""
    if isinstance(width, RowBuckets):
        return cut_by_rows(df, entity_cols, order_col, width)
    if width is None or not splitting_widths(df, order_col, [width]):
        return None
    return df.withColumn(_B, bucket_of(df, order_col, width))


def bucket_sql(df: DataFrame, order_col: str, width: int) -> str:
    name, dt = _lead_field(df, order_col)
    c = ".".join(q(p) for p in name.split("."))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        num = f"unix_micros(CAST({c} AS TIMESTAMP))"
    elif isinstance(dt, T.DateType):
        num = f"CAST(unix_date({c}) AS BIGINT)"
    else:
        num = f"CAST({c} AS BIGINT)"
    return f"CAST(floor({num} / {int(width)}) AS BIGINT)"


def splitting_widths(df: DataFrame, order_col: str, widths: Sequence[int] | None) -> list[int]:
    """The widths that actually cut the observed key range into more than one bucket.

    One cheap aggregate over the order key.  A level whose bucket covers the whole
    range changes nothing (every entity sits in one bucket), and neither does any
    wider level.  With unique integer keys a single bucket also bounds each
    entity's window partition by the bucket width."""
    if not widths:
        return []
    lo, hi = df.agg(F.min(order_number(df, order_col)), F.max(order_number(df, order_col))).first()
    if lo is None:
        return []
    return [w for w in widths if lo // w != hi // w]


def window_sql(partition: Sequence[str], order_col: str) -> str:
    part = f"PARTITION BY {', '.join(q(p) for p in partition)} " if partition else ""
    return f"{part}ORDER BY {q(order_col)}"


def rolling_select(
    df: DataFrame,
    entity_cols: Sequence[str],
    order_col: str,
    make_cols: Callable[[str], list[str]],
    lookback: int,
    bucket_widths: RowBuckets | Sequence[int] | None = DEFAULT_BUCKET_WIDTHS,
    _level: int = 0,
) -> DataFrame:
    """``df`` plus the SQL expressions ``make_cols(w)`` where ``w`` is the text of the
    entity window (``PARTITION BY ... ORDER BY ...``).

    ``make_cols`` must only read rows inside ``ROWS BETWEEN lookback PRECEDING
    AND CURRENT ROW`` of ``w`` (or ``lag(c, k)`` with ``k <= lookback``).
    Output rows are the input rows; the output is not ordered.
    """
    base_cols = list(df.columns)
    base = [q(c) for c in base_cols]
    entity_cols = list(entity_cols)
    cut = None
    if isinstance(bucket_widths, RowBuckets):
        # Every bucket is full but for chance, so its edges are few and one plain window repairs them.
        cut, bucket_widths = cut_by_rows(df, entity_cols, order_col, bucket_widths), None
    elif _level == 0 and bucket_widths:
        bucket_widths = splitting_widths(df, order_col, bucket_widths)
    if cut is None and not bucket_widths:
        return df.selectExpr(*base, *make_cols(window_sql(entity_cols, order_col)))

    rest = bucket_widths[1:] if bucket_widths else None
    bk, rn, cnt, head = (f"{n}{_level}" for n in (_B, _RN, _CNT, "__head"))
    parts = [*entity_cols, bk]
    w = window_sql(parts, order_col)
    pw = "PARTITION BY " + ", ".join(q(p) for p in parts)
    # One explicit shuffle on (entity, bucket): both consumers below (interior rows and
    # the edge rows feeding the next level) read it, so Spark reuses the exchange.
    source = cut.selectExpr(*base, f"{q(_B)} AS {q(bk)}") if cut is not None else df.selectExpr(
        *base, f"{bucket_sql(df, order_col, bucket_widths[0])} AS {q(bk)}")
    a = source.repartition(*parts).selectExpr(
        *base, q(bk), f"row_number() OVER ({w}) AS {q(rn)}", f"count(1) OVER ({pw}) AS {q(cnt)}", *make_cols(w))
    out_cols = [c for c in a.columns if c not in (bk, rn, cnt)]
    interior = a.where(F.col(rn) > lookback).select(*out_cols)
    edges = a.where((F.col(rn) <= lookback) | (F.col(cnt) - F.col(rn) < lookback)).select(
        *base_cols, (F.col(rn) <= lookback).alias(head))
    fixed = rolling_select(edges, entity_cols, order_col, make_cols, lookback, rest, _level + 1)
    heads = fixed.where(F.col(head)).select(*out_cols)
    return interior.unionByName(heads)


def _joined(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on the keys; a missing key equals a missing one."""
    names = [f"__k{i}" for i in range(len(keys))]
    on = F.lit(True)
    for k, n in zip(keys, names):
        on = on & F.col(q(k)).eqNullSafe(F.col(n))
    return rows.join(table.withColumnsRenamed(dict(zip(keys, names))), on).drop(*names)


def with_position(
    df: DataFrame,
    entity_cols: Sequence[str],
    order_col: str,
    name: str = "position",
    bucket_width: RowBuckets | int | None = DEFAULT_BUCKET_WIDTHS,
) -> DataFrame:
    """Add the exact 0-based position of each row within its entity."""
    entity_cols = list(entity_cols)
    b = bucketed(df, entity_cols, order_col, bucket_width)
    if b is None:
        return df.withColumn(name, (F.row_number().over(entity_window(entity_cols, order_col)) - 1).cast("long"))
    keys = [*entity_cols, _B]
    # One row per non-empty (entity, bucket): partial aggregation keeps hot hosts cheap.
    counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias(_CNT))
    w_pref = (Window.partitionBy(*entity_cols) if entity_cols else Window.partitionBy()).orderBy(_B)
    offsets = counts.select(
        *keys,
        (F.sum(_CNT).over(w_pref.rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
    ).fillna(0, subset=["__off"])
    # AQE broadcasts ``offsets`` when its measured size is small, else a
    # shuffle join on (entity, bucket) that spreads a hot host over buckets.
    joined = _joined(b, offsets, keys)
    w_in = Window.partitionBy(*keys).orderBy(order_col)
    return joined.select(
        *df.columns,
        (F.col("__off") + F.row_number().over(w_in) - 1).cast("long").alias(name),
    )


def first_n_per_entity(
    df: DataFrame, entity_cols: Sequence[str], order_col: str | Sequence, n: int,
    name: str = "__rank", keep_rank: bool = False,
) -> DataFrame:
    """Top-n rows per entity by order.  ``row_number() <= n`` directly above the
    window lets Spark insert a partial ``WindowGroupLimit`` before the shuffle,
    so a hot entity ships at most n rows per input partition."""
    orders = [order_col] if isinstance(order_col, (str, Column)) else list(order_col)
    w = (Window.partitionBy(*entity_cols) if entity_cols else Window.partitionBy()).orderBy(*orders)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if keep_rank else out.drop(name)


def running_last(
    df: DataFrame,
    entity_cols: Sequence[str],
    order_col: str,
    value_col: str,
    name: str,
    bucket_width: RowBuckets | int | None = DEFAULT_BUCKET_WIDTHS,
) -> DataFrame:
    """For each row, the last non-NULL ``value_col`` at or before it (in order) within the entity.

    Bucketed like ``with_position``: the last value inside each (entity, bucket)
    is a window over that bucket; the value carried in from earlier buckets comes
    from a small per-bucket table (one row per non-empty bucket) and a join."""
    entity_cols = list(entity_cols)
    b = bucketed(df, entity_cols, order_col, bucket_width)
    if b is None:
        w = entity_window(entity_cols, order_col).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value_col, ignorenulls=True).over(w))
    keys = [*entity_cols, _B]
    per_bucket = b.groupBy(*keys).agg(
        F.max_by(F.col(value_col), F.when(F.col(value_col).isNotNull(), F.col(order_col))).alias("__lastv"))
    w_pref = (Window.partitionBy(*entity_cols) if entity_cols else Window.partitionBy()).orderBy(_B)
    carried = per_bucket.select(*keys, F.last("__lastv", ignorenulls=True).over(
        w_pref.rowsBetween(Window.unboundedPreceding, -1)).alias("__carry"))
    j = _joined(b, carried, keys)
    w_in = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*df.columns, F.coalesce(F.last(value_col, ignorenulls=True).over(w_in),
                                            F.col("__carry")).alias(name))
