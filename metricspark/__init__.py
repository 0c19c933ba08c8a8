"""metricspark: host-metrics analytics as Spark DataFrame operators.

Every operator is a function ``DataFrame -> DataFrame`` (usable with
``df.transform``) with explicit order and entity columns, so one code path
serves one series or many hosts in parallel.
"""

__version__ = "0.1.0"
