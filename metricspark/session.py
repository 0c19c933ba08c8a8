"""Session helpers: a tuned local session for tests/bench and a shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every operator in the package.  AQE re-plans joins at
# run time (broadcast only when the measured side is small, split skewed
# partitions otherwise) and coalesces small shuffle partitions.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Wide one-pass fits (e.g. mean + variance of ~35 feature columns) exceed the default
    # 100 buffer fields and would run without whole-stage codegen; Spark still falls back
    # on its own if a generated method grows too large.
    "spark.sql.codegen.maxFields": "1000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "metricspark") -> SparkSession:
    """Session for tests and the bench (local mode).  On a cluster use the cluster's session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    scratch_root(spark)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and intermediate tables.

    Uses ``spark.checkpoint.dir`` (the cluster's shared folder) when the
    session names one.  Only when it is unset in local mode (tests) a fresh
    folder is created and registered as the checkpoint dir; elsewhere that is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir.rstrip("/")
    cp = spark.sparkContext.getCheckpointDir()
    if cp:
        # Spark appends a random sub-folder; its parent is the configured root.
        return os.path.dirname(cp.rstrip("/"))
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="metricspark-")
    spark.sparkContext.setCheckpointDir(local)
    return local


_SCRATCH: dict[str, list[str]] = {}
# What modules remember of tables in the scratch folder; forgotten when these are dropped.
CACHES: list[dict] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared scratch root."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the tables that this application's operators wrote to the shared folder; returns how many there
    were.  To be called when their results have been used: these read the tables."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for c in CACHES:
        c.clear()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += path.getFileSystem(conf).delete(path, True)
    return n


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: a frame that is read several times is
    computed once, and its lineage is cut."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()
_ZIP_DIR: tempfile.TemporaryDirectory | None = None


def ship_package(spark: SparkSession) -> None:
    """Make ``metricspark`` importable in executor Python workers (``addPyFile``), once per
    application.  Needed by operators that run pandas functions on executors: the
    functions are pickled by reference to this package."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile

    import metricspark
    global _ZIP_DIR
    root = os.path.dirname(os.path.abspath(metricspark.__file__))
    # Executors fetch the file from the driver while the application runs; it goes when Python ends.
    _ZIP_DIR = tempfile.TemporaryDirectory(prefix="metricspark-pyfiles-", ignore_cleanup_errors=True)
    path = os.path.join(_ZIP_DIR.name, "metricspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
