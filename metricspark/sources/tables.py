"""Binding of the driver's parquet tables onto the metrics / tasks data model.

``metrics``: one row per host sample.  Order key ``row_key`` (unique),
entity ``host_id``.  ``tasks``: one row per task, group ``group_id``, unique
``task_id``.  The same text is kept as SQL (``METRICS_SQL``/``TASKS_SQL``) so
that a DuckDB oracle can build identical views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null

ORDER_COL = "row_key"
ENTITY_COL = "host_id"
TIME_COL = "timestamp"
LABEL_COL = "status"

# Known metric columns of the host-metrics data model (fixed values).
METRIC_COLUMNS = [
    "cpu_utilization", "memory_usage", "network_latency", "power_consumption",
    "disk_io", "thread_count", "process_count", "uptime", "status",
]

METRICS_SQL = """
SELECT event_id AS row_key, user_id AS host_id, ts AS timestamp,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / 5e0 END AS cpu_utilization,
  CASE WHEN event_id % 23 = 0 THEN NULL
       ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) END AS memory_usage,
  value AS network_latency,
  1e2 + value * 3e-1 AS power_consumption,
  CAST((event_id * 37) % 1000 AS DOUBLE) / 1e1 AS disk_io,
  CAST(1 + event_id % 64 AS INT) AS thread_count,
  CAST(1 + user_id % 16 AS INT) AS process_count,
  event_id * 60 AS uptime,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS status
FROM events
"""

TASKS_SQL = """
SELECT o_custkey AS group_id, o_orderkey AS task_id,
  5e0 + CAST(o_orderkey % 16 AS DOUBLE) AS cpu_req,
  1e1 + CAST((o_orderkey * 7) % 21 AS DOUBLE) AS memory_req,
  6 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority
FROM orders
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def metrics_from_events(events: DataFrame) -> DataFrame:
    """Project the ``events`` table onto the host-metrics schema (pure projection, no shuffle).

    NaN becomes NULL here, so no operator downstream sees one.
    """
    events = nan_to_null(events)
    eid, uid = F.col("event_id"), F.col("user_id")
    return events.select(
        eid.alias("row_key"),
        uid.alias("host_id"),
        F.col("ts").alias("timestamp"),
        F.when(eid % 17 == 0, F.lit(None)).otherwise(F.col("value") / 5.0).alias("cpu_utilization"),
        F.when(eid % 23 == 0, F.lit(None))
        .otherwise(F.regexp_extract("props", "([0-9]+)", 1).cast("double")).alias("memory_usage"),
        F.col("value").alias("network_latency"),
        (F.lit(100.0) + F.col("value") * 0.3).alias("power_consumption"),
        (((eid * 37) % 1000).cast("double") / 10.0).alias("disk_io"),
        (F.lit(1) + eid % 64).cast("int").alias("thread_count"),
        (F.lit(1) + uid % 16).cast("int").alias("process_count"),
        (eid * 60).alias("uptime"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("status"),
    )


def tasks_from_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        F.col("o_custkey").alias("group_id"),
        k.alias("task_id"),
        (F.lit(5.0) + (k % 16).cast("double")).alias("cpu_req"),
        (F.lit(10.0) + ((k * 7) % 21).cast("double")).alias("memory_req"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
    )


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from_events(table(spark, sf_dir, "events"))


def load_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks_from_orders(table(spark, sf_dir, "orders"))
