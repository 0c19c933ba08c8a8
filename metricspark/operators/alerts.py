"""Live-metric records, KPI status, threshold alerts, suppression and recent lists (batch forms).

The streaming forms live in ``metricspark.streaming`` and reuse these
expressions, so a stream's final result equals its batch twin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import DEFAULT_BUCKET_WIDTHS, first_level, first_n_per_entity, rolling_select, running_last, with_position

# Feed defaults (fixed values): value used when a metric is missing.
FEED_DEFAULTS = {"cpu_usage": 50.0, "memory_usage": 60.0, "network_traffic": 50.0}
FEED_SOURCE = {"cpu_usage": "cpu_utilization", "memory_usage": "memory_usage",
               "network_traffic": "network_latency"}
# KPI thresholds (fixed values): above 80 danger, above 60 warning, else success.
KPI_DANGER, KPI_WARNING = 80.0, 60.0
# Threshold alerts (fixed values): metric, limit, message prefix, unit, severity.
ALERT_RULES = [
    ("cpu_usage", 85.0, "High CPU Usage: ", "%", "critical"),
    ("memory_usage", 85.0, "High Memory Usage: ", "%", "critical"),
    ("network_traffic", 85.0, "High Network Traffic: ", " Mbps", "warning"),
]
SUPPRESS_SECONDS = 5.0
# Predicted-load alert (fixed values).
LOAD_CRITICAL, LOAD_WARNING = 80.0, 60.0


def metric_feed(df: DataFrame, keep: Sequence[str] = ("row_key", "host_id", "timestamp"),
                source: str = "csv_data") -> DataFrame:
    """One dashboard record per row: defaults only for NULL (a real 0 stays 0)."""
    cols = [F.coalesce(F.col(src).cast("double") if src in df.columns else F.lit(None).cast("double"),
                       F.lit(FEED_DEFAULTS[out])).alias(out) for out, src in FEED_SOURCE.items()]
    return df.select(*[c for c in keep if c in df.columns], *cols,
                     F.lit("operational").alias("status"), F.lit(source).alias("source"))


def metric_fallback(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Column means (raw units), then constants; tagged with the source used."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for out, src in FEED_SOURCE.items():
        mean = F.avg(F.col(src).cast("double")) if src in df.columns else F.lit(None).cast("double")
        aggs.append(F.coalesce(mean, F.lit(FEED_DEFAULTS[out])).alias(out))
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    has = F.col("__n") > 0
    return g.select(*by, *FEED_SOURCE.keys(),
                    F.when(has, "operational").otherwise("waiting_for_data").alias("status"),
                    F.when(has, "dataset_stats").otherwise("default").alias("source"))


def kpi_status(c: Column) -> Column:
    return F.when(c > KPI_DANGER, "danger").when(c > KPI_WARNING, "warning").otherwise("success")


def current_load_level(cpu: Column, mem: Column) -> Column:
    avg = (cpu + mem) / 2.0
    return (F.when(avg < 40, "LOW").when(avg < 60, "MEDIUM").when(avg < 80, "HIGH").otherwise("CRITICAL"))


def js_round(c: Column) -> Column:
    """``Math.round``: floor(x + 0.5)."""
    return F.floor(c + F.lit(0.5))


def threshold_alerts(feed: DataFrame, keep: Sequence[str] = ("row_key", "host_id", "timestamp")) -> DataFrame:
    """One row per fired rule: (keep..., metric, message, severity)."""
    rules = F.array(*[
        F.when(F.col(m) > lim, F.struct(F.lit(m).alias("metric"),
                                        F.concat(F.lit(prefix), js_round(F.col(m)).cast("string"),
                                                 F.lit(unit)).alias("message"),
                                        F.lit(sev).alias("severity")))
        for m, lim, prefix, unit, sev in ALERT_RULES])
    return feed.select(*keep, F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("a")).select(
        *keep, "a.metric", "a.message", "a.severity")


def suppress(alerts: DataFrame, key_cols: Sequence[str] = ("host_id", "message"), time_col: str = "timestamp",
             window_s: float = SUPPRESS_SECONDS, id_col: str = "row_key", chunk: int = 100_000,
             bucket_widths=DEFAULT_BUCKET_WIDTHS) -> DataFrame:
    """Keep an alert unless a *kept* alert of the same key fired less than ``window_s`` earlier.

    Exact, and no task folds more than ``chunk`` alerts:

    * An alert at least ``window_s`` after the previous alert of its key is
      always kept, so it starts an independent *episode*.  The gap comes from a
      skew-safe lag (key-range buckets), the episode id (its start time) from a
      bucketed running "last start".
    * Inside an episode the rule is sequential.  Each alert gets its exact
      position in the episode; round r folds positions [r*chunk, (r+1)*chunk)
      of every episode that long, starting from the last kept time carried
      from round r-1 (``aggregate`` over at most ``chunk`` sorted alerts).
      Rounds are needed only for episodes longer than ``chunk``.
    """
    key_cols = list(key_cols)
    win_us = int(window_s * 1_000_000)
    a = alerts.withColumn("__us", epoch_micros(F.col(time_col)))
    # Order within a key: (time, id); key ranges are cut on the time.
    a = a.withColumn("__okey", F.struct(F.col("__us").alias("us"), F.col(id_col).alias("id")))

    def prev(w):
        return [f"lag(__us, 1) OVER ({w}) AS __prev"]
    a = rolling_select(a, key_cols, "__okey", prev, 1, bucket_widths)
    a = a.withColumn("__start", F.when(F.col("__prev").isNull() | (F.col("__us") - F.col("__prev") >= win_us),
                                       F.col("__us")))
    a = running_last(a, key_cols, "__okey", "__start", "__ep",
                     first_level(bucket_widths))
    ekeys = [*key_cols, "__ep"]
    a = a.select(*key_cols, "__ep", "__okey", "__us", id_col).checkpoint()
    longest = a.groupBy(*ekeys).count().agg(F.max("count")).first()[0] or 0
    if longest <= chunk:
        # size checked: every episode fits one fold
        a = a.withColumn("__chunk", F.lit(0).cast("long"))
    else:
        a = with_position(a, ekeys, "__okey", "__pos", first_level(bucket_widths))
        a = a.withColumn("__chunk", (F.col("__pos") / chunk).cast("long"))
    a = a.select(*key_cols, "__ep", "__chunk", "__us", id_col)
    id_type = alerts.schema[id_col].dataType.simpleString()

    def step(acc, x):
        keep = acc["last"].isNull() | (x["__us"] - acc["last"] >= win_us)
        return F.struct(F.when(keep, x["__us"]).otherwise(acc["last"]).alias("last"),
                        F.when(keep, F.concat(acc["ids"], F.array(x[id_col]))).otherwise(acc["ids"]).alias("ids"))

    if longest > chunk:
        a = a.checkpoint()
    n_rounds = 0 if longest <= chunk else a.agg(F.max("__chunk")).first()[0]
    kept_parts, state = [], None
    for r in range(0 if n_rounds is None else int(n_rounds) + 1):
        part = a.where(F.col("__chunk") == r).groupBy(*ekeys).agg(
            F.array_sort(F.collect_list(F.struct("__us", id_col))).alias("__xs"))
        start = F.lit(None).cast("long")
        if state is not None:
            part = part.join(state, ekeys, "left")
            start = F.col("__last")
        init = F.struct(start.alias("last"), F.array().cast(f"array<{id_type}>").alias("ids"))
        folded = part.select(*ekeys, F.aggregate("__xs", init, step).alias("__r"))
        if n_rounds:                     # more than one round: cut lineage between rounds
            folded = folded.checkpoint()
        kept_parts.append(folded.select(*key_cols, F.explode("__r.ids").alias(id_col)))
        nxt = folded.select(*ekeys, F.col("__r.last").alias("__last"))
        state = nxt if state is None else state.join(nxt, ekeys, "full").select(
            *ekeys, F.coalesce(nxt["__last"], state["__last"]).alias("__last"))
    if not kept_parts:
        return alerts.limit(0)
    kept = kept_parts[0]
    for k in kept_parts[1:]:
        kept = kept.unionByName(k)
    return alerts.join(kept, [*key_cols, id_col], "left_semi")


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP or TIMESTAMP_NTZ, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            ts.cast("timestamp_ntz"))


def newest_first(df: DataFrame, entity_cols: Sequence[str], order_cols: Sequence, cap: int, show: int) -> DataFrame:
    """Newest-first list capped at ``cap`` per entity, with ``rank`` and a ``shown`` flag for the first ``show``."""
    out = first_n_per_entity(df, entity_cols, list(order_cols), cap, name="rank", keep_rank=True)
    return out.withColumn("shown", F.col("rank") <= show)


def predicted_load_alert(preds: DataFrame, by: Sequence[str], cpu_col: str = "cpu_pred",
                         mem_col: str | None = "mem_pred", critical: float = LOAD_CRITICAL,
                         warning: float = LOAD_WARNING) -> DataFrame:
    """Mean predicted load per entity -> critical / warning alert; memory counts only if its mean > 0."""
    aggs = [F.avg(cpu_col).alias("avg_cpu"),
            (F.avg(mem_col) if mem_col else F.lit(None).cast("double")).alias("avg_memory")]
    g = preds.groupBy(*by).agg(*aggs).fillna(0.0, ["avg_memory"])
    load = F.when(F.col("avg_memory") > 0, (F.col("avg_cpu") + F.col("avg_memory")) / 2.0).otherwise(F.col("avg_cpu"))
    g = g.withColumn("avg_pred", load)
    sev = F.when(F.col("avg_pred") > critical, "critical").when(F.col("avg_pred") > warning, "warning")
    head = F.when(F.col("avg_pred") > critical, "High").otherwise("Elevated")
    msg = F.format_string("%s predicted load (CPU %.1f%%, Memory %.1f%%): %.1f%%",
                          head, F.col("avg_cpu"), F.col("avg_memory"), F.col("avg_pred"))
    return g.select(*by, "avg_cpu", "avg_memory", "avg_pred", sev.alias("severity"), msg.alias("message")).where(
        F.col("severity").isNotNull())
