"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``
over the whole driver tables, with its DuckDB oracle statement next to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import numeric_columns
from ..functions.hashing import PRIME, hashed_sql
from ..functions.sqlexpr import q
from ..operators import anomaly, clean, features, leastsq, predict, profile, scale
from ..sources import csv as csvsrc
from ..sources import records
from ..sources.tables import load_metrics
from ..session import CACHES, scratch_path, stored
from . import sqltext as S
from .order import first_n_per_entity, with_position
from .pipeline import preprocess

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ENTITY, ORDER = ["host_id"], "row_key"
ROLES = ["row_key", "host_id"]


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.selectExpr(*[f"round({q(f.name)}, {digits}) AS {q(f.name)}"
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else q(f.name)
                           for f in df.schema.fields])


def metric_value_cols(df: DataFrame) -> list[str]:
    return numeric_columns(df, exclude=ROLES)


# ---------------------------------------------------------------- A. sources
@register("scan_csv_first_n", S.with_ctes([], "SELECT * FROM metrics ORDER BY row_key LIMIT 1000"))
def q_scan_csv_first_n(spark, sf_dir):
    m = load_metrics(spark, sf_dir)
    path = scratch_path(spark, "metrics-csv")
    csvsrc.write_csv(m, path)
    return csvsrc.scan_first_n(spark, path, [ORDER], 1000, schema=m.schema)


def _inferred_sql():
    cols = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in ("thread_count", "process_count", "uptime", "status") else c for c in S.ALL)
    return S.with_ctes([], f"SELECT {cols} FROM metrics ORDER BY row_key LIMIT 1000")


@register("scan_csv_inferred", _inferred_sql())
def q_scan_csv_inferred(spark, sf_dir):
    """Types are found from the text, with missing values written as ``NA``."""
    path = scratch_path(spark, "metrics-csv")
    csvsrc.write_csv(load_metrics(spark, sf_dir), path, missing="NA")
    return csvsrc.scan_first_n(spark, path, [ORDER], 1000)


@register("preview_head", S.with_ctes([], "SELECT * FROM metrics ORDER BY row_key LIMIT 20"))
def q_preview_head(spark, sf_dir):
    return records.preview(load_metrics(spark, sf_dir), [ORDER], 20)


@register("preview_formatted", S.with_ctes([], (
    "SELECT round(CAST(row_key AS DOUBLE), 2) AS row_key, round(CAST(host_id AS DOUBLE), 2) AS host_id, "
    "timestamp, round(cpu_utilization, 2) AS cpu_utilization, round(memory_usage, 2) AS memory_usage, "
    "round(network_latency, 2) AS network_latency FROM metrics ORDER BY row_key LIMIT 5")))
def q_preview_formatted(spark, sf_dir):
    return records.preview(load_metrics(spark, sf_dir), [ORDER], 5, max_cols=6, digits=2)


_SCHEMA_SQL = S.with_ctes([("d", "SELECT * FROM (DESCRIBE SELECT * FROM metrics)")], (
    "SELECT CAST(row_number() OVER () - 1 AS INT) AS ordinal, column_name, CASE upper(column_type) "
    "WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'VARCHAR' THEN 'string' "
    "ELSE lower(column_type) END AS data_type, (SELECT count(*) FROM metrics) AS n_rows, "
    "CAST(count(*) OVER () AS INT) AS n_columns FROM d"))


@register("schema_report", _SCHEMA_SQL)
def q_schema_report(spark, sf_dir):
    return profile.schema_report(load_metrics(spark, sf_dir))


_JSON_FIELDS = ", ".join(
    f"'{c}': {'CAST(timestamp AS VARCHAR)' if c == 'timestamp' else c}" for c in S.ALL)


@register("rows_to_json", S.with_ctes([], f"SELECT row_key, CAST(to_json({{{_JSON_FIELDS}}}) AS VARCHAR) AS record "
                                          "FROM metrics"))
def q_rows_to_json(spark, sf_dir):
    return records.rows_to_json(load_metrics(spark, sf_dir), ["row_key"])


# ---------------------------------------------------------------- B. profiling
@register("profile_missing", S.with_ctes([("m", " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM metrics"
    for i, c in enumerate(S.ALL)))],
    "SELECT ordinal, column_name, n_missing, CAST(sum(n_missing) OVER () AS BIGINT) AS total_missing FROM m"))
def q_profile_missing(spark, sf_dir):
    return profile.profile_missing(load_metrics(spark, sf_dir))


DUP_COLS = ["host_id", "status", "memory_usage"]


@register("profile_duplicates", S.with_ctes([], (
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM "
    f"(SELECT count(*) AS n FROM metrics GROUP BY {', '.join(DUP_COLS)}) g")))
def q_profile_duplicates(spark, sf_dir):
    return profile.profile_duplicates(load_metrics(spark, sf_dir), DUP_COLS)


# row_key is the surrogate that gives rows their order, so it's not part of the row
_ROW = [c for c in S.ALL if c != "row_key"]


@register("profile_duplicates_full_row", S.with_ctes([], (
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM "
    f"(SELECT count(*) AS n FROM metrics GROUP BY {', '.join(_ROW)}) g")))
def q_profile_duplicates_full_row(spark, sf_dir):
    return profile.profile_duplicates(load_metrics(spark, sf_dir), _ROW)


@register("profile_describe", S.rounded(S.with_ctes([], " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, count({c}) AS count, avg({S.d(c)}) AS mean, "
    f"stddev_samp({S.d(c)}) AS std, min({S.d(c)}) AS min, quantile_cont({S.d(c)}, 0.25) AS p25, "
    f"quantile_cont({S.d(c)}, 0.5) AS p50, quantile_cont({S.d(c)}, 0.75) AS p75, max({S.d(c)}) AS max FROM metrics"
    for i, c in enumerate(S.NUM))), ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def q_profile_describe(spark, sf_dir):
    m = load_metrics(spark, sf_dir)
    return round_doubles(profile.profile_describe(m, metric_value_cols(m)))


_HIST = ["cpu_utilization", "memory_usage", "network_latency", "power_consumption"]


@register("histogram_30", S.rounded(S.with_ctes([
    ("long", " UNION ALL ".join(f"SELECT '{c}' AS column_name, {S.d(c)} AS v FROM metrics WHERE {c} IS NOT NULL"
                                for c in _HIST)),
    ("rng0", "SELECT column_name, min(v) AS vmin, max(v) AS vmax FROM long GROUP BY column_name"),
    ("rng", "SELECT column_name, CASE WHEN vmin = vmax THEN vmin - 0.5e0 ELSE vmin END AS lo, "
            "CASE WHEN vmin = vmax THEN vmax + 0.5e0 ELSE vmax END AS hi FROM rng0"),
    ("binned", "SELECT l.column_name, CAST(least(floor((v - lo) * 30 / (hi - lo)), 29) AS INT) AS bin, "
               "count(*) AS cnt FROM long l JOIN rng r ON l.column_name = r.column_name GROUP BY 1, 2"),
    ("grid", "SELECT column_name, lo, hi, CAST(b AS INT) AS bin FROM rng CROSS JOIN range(0, 30) t(b)"),
], "SELECT g.column_name, g.bin, lo + g.bin * ((hi - lo) / 30) AS bin_lo, "
   "lo + (g.bin + 1) * ((hi - lo) / 30) AS bin_hi, CAST(coalesce(cnt, 0) AS BIGINT) AS count "
   "FROM grid g LEFT JOIN binned b ON g.column_name = b.column_name AND g.bin = b.bin"), ["bin_lo", "bin_hi"]))
def q_histogram_30(spark, sf_dir):
    return round_doubles(profile.histogram(load_metrics(spark, sf_dir), _HIST, 30))


@register("correlation_matrix", S.rounded(S.with_ctes([], " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({S.d(a)}, {S.d(b)}) AS corr FROM metrics"
    for a in S.NUM for b in S.NUM)), ["corr"]))
def q_correlation_matrix(spark, sf_dir):
    m = load_metrics(spark, sf_dir)
    return round_doubles(profile.correlation_matrix(m, metric_value_cols(m)))


_MA = ["cpu_utilization", "memory_usage", "power_consumption"]
_MA_FR = f"({S.W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@register("moving_avg_20", S.rounded(S.with_ctes([], "SELECT row_key, host_id, " + ", ".join(
    f"{c}, CASE WHEN count({c}) OVER {_MA_FR} = 20 THEN avg({c}) OVER {_MA_FR} END AS {c}_ma20" for c in _MA)
    + " FROM metrics"), [f"{c}_ma20" for c in _MA]))
def q_moving_avg_20(spark, sf_dir):
    m = load_metrics(spark, sf_dir).select("row_key", "host_id", *_MA)
    return round_doubles(features.moving_average(m, ENTITY, ORDER, _MA, 20))


@register("insights", S.rounded(S.with_ctes([
    ("i", "SELECT max(cpu_utilization) AS high_cpu, avg(memory_usage) AS avg_memory, "
          "max(network_latency) AS high_latency, avg(power_consumption) AS avg_power FROM metrics")],
    "SELECT * FROM (SELECT 'high_cpu' AS insight, high_cpu AS value FROM i UNION ALL "
    "SELECT 'avg_memory', avg_memory FROM i UNION ALL SELECT 'high_latency', high_latency FROM i UNION ALL "
    "SELECT 'avg_power', avg_power FROM i) u WHERE value IS NOT NULL"), ["value"]))
def q_insights(spark, sf_dir):
    return round_doubles(profile.insights(load_metrics(spark, sf_dir)))


@register("uptime_range", S.with_ctes([], "SELECT CAST(min(uptime) AS DOUBLE) AS uptime_min, "
                                          "CAST(max(uptime) AS DOUBLE) AS uptime_max FROM metrics"))
def q_uptime_range(spark, sf_dir):
    return profile.uptime_range(load_metrics(spark, sf_dir))


_EDA_N = 1000


@register("eda_on_sample", S.rounded(S.with_ctes([
    ("s", f"SELECT * FROM metrics ORDER BY row_key LIMIT {_EDA_N}"),
    ("b", "SELECT count(*) AS n_rows, CAST(" + " + ".join(
        f"count(*) FILTER (WHERE {c} IS NULL)" for c in S.ALL) + " AS BIGINT) AS total_missing, "
        "max(cpu_utilization) AS high_cpu, avg(memory_usage) AS avg_memory, max(network_latency) AS high_latency, "
        f"avg(power_consumption) AS avg_power, {len(S.ALL)} AS n_columns FROM s"),
    ("dup", f"SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM "
            f"(SELECT count(*) AS n FROM s GROUP BY {', '.join(_ROW)}) g")],
    "SELECT * FROM b CROSS JOIN dup"), ["high_cpu", "avg_memory", "high_latency", "avg_power"]))
def q_eda_on_sample(spark, sf_dir):
    m = load_metrics(spark, sf_dir)
    return round_doubles(profile.eda_summary(m, _EDA_N, [ORDER], exclude_dup=("row_key",)))


# ---------------------------------------------------------------- C. cleaning
def _filled_sql(agg):
    return S.rounded(S.with_ctes(S.imputed_ctes(agg=agg), "SELECT * FROM imputed"), S.NUM)


@register("impute_mean", _filled_sql("mean"))
def q_impute_mean(spark, sf_dir):
    m = load_metrics(spark, sf_dir)
    return round_doubles(clean.impute(m, "mean", roles=ROLES))


@register("impute_median", _filled_sql("median"))
def q_impute_median(spark, sf_dir):
    m = load_metrics(spark, sf_dir)
    return round_doubles(clean.impute(m, "median", roles=ROLES))


@register("drop_nulls", S.with_ctes([], "SELECT * FROM metrics WHERE " + " AND ".join(
    f"{c} IS NOT NULL" for c in S.ALL)))
def q_drop_nulls(spark, sf_dir):
    return clean.impute(load_metrics(spark, sf_dir), "drop")


@register("clip_iqr", S.rounded(S.with_ctes(S.clipped_ctes(src="metrics"), "SELECT * FROM clipped"), S.NUM))
def q_clip_iqr(spark, sf_dir):
    return round_doubles(clean.clip_iqr(load_metrics(spark, sf_dir), roles=ROLES, threshold=1.5))


def _zrep_sql(t="3e0"):
    stats = ", ".join(f"avg({S.d(c)}) AS mu_{c}, stddev_pop({S.d(c)}) AS sd_{c}, "
                      f"quantile_cont({S.d(c)}, 0.5) AS md_{c}" for c in S.NUM)
    sel = ", ".join(
        f"CASE WHEN abs(({S.d(c)} - mu_{c}) / nullif(sd_{c}, 0e0)) > {t} THEN md_{c} ELSE {S.d(c)} END AS {c}"
        if c in S.NUM else c for c in S.ALL)
    return S.rounded(S.with_ctes([("zs", f"SELECT {stats} FROM metrics")],
                                 f"SELECT {sel} FROM metrics CROSS JOIN zs"), S.NUM)


@register("replace_zscore_median", _zrep_sql())
def q_replace_zscore_median(spark, sf_dir):
    return round_doubles(clean.replace_zscore(load_metrics(spark, sf_dir), roles=ROLES, threshold=3.0))


# ---------------------------------------------------------------- D. features
def _feature_query(kind):
    def q(spark, sf_dir):
        m = load_metrics(spark, sf_dir)
        cols = [c for c in metric_value_cols(m) if c != "status"]
        out = features.rolling_features(m.select(*ROLES, *cols), ENTITY, ORDER, cols, 3)
        suffix = {"avg": "_rolling_avg", "std": "_rolling_std", "lag": "_lag1"}[kind]
        return round_doubles(out.select(*ROLES, *[c + suffix for c in cols]))
    return q


def _feature_sql(kind):
    suffix = {"avg": "_rolling_avg", "std": "_rolling_std", "lag": "_lag1"}[kind]
    exprs = [e for e in S.rolling_sql(S.FEAT_SRC) if e.endswith(suffix)]
    dbl = [c + suffix for c in S.FEAT_SRC] if kind != "lag" else \
        [c + suffix for c in S.FEAT_SRC if c in S.NUM[:5]]
    return S.rounded(S.with_ctes([], f"SELECT row_key, host_id, {', '.join(exprs)} FROM metrics"), dbl)


register("rolling_avg_3", _feature_sql("avg"))(_feature_query("avg"))
register("rolling_std_3", _feature_sql("std"))(_feature_query("std"))
register("lag_1", _feature_sql("lag"))(_feature_query("lag"))


@register("ratio_features", S.rounded(S.with_ctes([], "SELECT row_key, " + ", ".join(S.ratio_sql())
                                                  + " FROM metrics"), [n for n, _, _ in S.RATIOS]))
def q_ratio_features(spark, sf_dir):
    out = features.ratio_features(load_metrics(spark, sf_dir))
    return round_doubles(out.select("row_key", *[n for n, _, _ in features.RATIOS]))


@register("preprocess_pipeline", S.rounded(S.with_ctes(S.processed_ctes(), "SELECT * FROM processed"),
                                           S.processed_doubles()))
def q_preprocess_pipeline(spark, sf_dir):
    return round_doubles(preprocess(load_metrics(spark, sf_dir)).df)


def _report_sql():
    feats = S.feature_names()
    n_feat = len([c for c in S.NUM + feats if c not in ("status", "cpu_utilization")])
    return S.with_ctes(S.processed_ctes(), (
        f"SELECT (SELECT count(*) FROM metrics) AS original_rows, {len(S.ALL)} AS original_columns, "
        f"count(*) AS processed_rows, {len(S.processed_columns())} AS processed_columns, "
        f"{n_feat} AS n_features, '{','.join(feats)}' AS new_features FROM processed"))


@register("preprocess_report", _report_sql())
def q_preprocess_report(spark, sf_dir):
    m = load_metrics(spark, sf_dir)
    p = preprocess(m)
    n_orig = m.agg(F.count(F.lit(1)).alias("original_rows"))
    n_proc = p.df.agg(F.count(F.lit(1)).alias("processed_rows"))
    return n_orig.crossJoin(n_proc).select(
        "original_rows", F.lit(len(m.columns)).alias("original_columns"), "processed_rows",
        F.lit(len(p.df.columns)).alias("processed_columns"),
        F.lit(len(p.feature_columns("cpu_utilization"))).alias("n_features"),
        F.lit(",".join(p.new_features)).alias("new_features"))


# ---------------------------------------------------------------- E. scaling
_SCALE = [c for c in S.NUM if c != "status"]


def _scaled_sql(method):
    if method == "standard":
        stats = ", ".join(f"avg({S.d(c)}) AS mu_{c}, CASE WHEN stddev_pop({S.d(c)}) = 0 THEN 1e0 "
                          f"ELSE stddev_pop({S.d(c)}) END AS sc_{c}" for c in _SCALE)
        expr = "({x} - mu_{c}) / sc_{c}"
    else:
        stats = ", ".join(f"1e0 / CASE WHEN max({S.d(c)}) - min({S.d(c)}) = 0 THEN 1e0 ELSE "
                          f"max({S.d(c)}) - min({S.d(c)}) END AS sc_{c}, min({S.d(c)}) AS lo_{c}" for c in _SCALE)
        expr = "{x} * sc_{c} + (-lo_{c} * sc_{c})"
    return [("ss0", f"SELECT {stats} FROM metrics")], expr


def _scale_sql(method):
    ctes, expr = _scaled_sql(method)
    sel = ", ".join(expr.format(x=S.d(c), c=c) + f" AS {c}" if c in _SCALE else c for c in S.ALL)
    return S.rounded(S.with_ctes(ctes, f"SELECT {sel} FROM metrics CROSS JOIN ss0"), _SCALE)


@register("scale_standard", _scale_sql("standard"))
def q_scale_standard(spark, sf_dir):
    return round_doubles(scale.scale(load_metrics(spark, sf_dir), "standard", roles=ROLES)[0])


@register("scale_minmax", _scale_sql("minmax"))
def q_scale_minmax(spark, sf_dir):
    return round_doubles(scale.scale(load_metrics(spark, sf_dir), "minmax", roles=ROLES)[0])


def _inverse_sql(method, col="cpu_utilization"):
    ctes, expr = _scaled_sql(method)
    sc = expr.format(x=S.d(col), c=col)
    if method == "standard":
        inv = f"(({sc}) * sc_{col} + mu_{col})"
    else:
        inv = f"((({sc}) - (-lo_{col} * sc_{col})) / (sc_{col} + 1e-12))"
    return S.rounded(S.with_ctes(ctes, f"SELECT row_key, {col} AS original, {sc} AS scaled, {inv} AS restored "
                                       "FROM metrics CROSS JOIN ss0"), ["original", "scaled", "restored"])


def _inverse_query(method, col="cpu_utilization"):
    def q(spark, sf_dir):
        m = load_metrics(spark, sf_dir)
        model = scale.fit_scaler(m, method=method, roles=ROLES)
        s = m.select("row_key", F.col(col).alias("original"), scale.scaled(F.col(col), col, model).alias("scaled"))
        return round_doubles(scale.inverse_values(s, model, "scaled", col, out="restored"))
    return q


register("inverse_standard", _inverse_sql("standard"))(_inverse_query("standard"))
register("inverse_minmax", _inverse_sql("minmax"))(_inverse_query("minmax"))

_INV = ["cpu_utilization", "memory_usage", "power_consumption", "network_latency", "disk_io"]


def _inverse_frame_sql():
    ctes, expr = _scaled_sql("standard")
    sel = []
    for c in S.ALL:
        if c in _SCALE:
            sx = expr.format(x=S.d(c), c=c)
            sel.append(f"(({sx}) * sc_{c} + mu_{c}) AS {c}" if c in _INV else f"{sx} AS {c}")
        else:
            sel.append(c)
    return S.rounded(S.with_ctes(ctes, f"SELECT {', '.join(sel)} FROM metrics CROSS JOIN ss0"), _SCALE)


@register("inverse_frame", _inverse_frame_sql())
def q_inverse_frame(spark, sf_dir):
    m = load_metrics(spark, sf_dir)
    scaled_df, model = scale.scale(m, "standard", roles=ROLES)
    return round_doubles(scale.inverse_frame(scaled_df, model, _INV + ["not_a_column"]))


# ---------------------------------------------------------------- F. model preparation
def _feature_columns_sql():
    names = [c for c in S.processed_columns() if c not in ("row_key", "host_id", "timestamp", "status",
                                                            "cpu_utilization")]
    values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return S.with_ctes(S.processed_ctes(), (
        "SELECT CAST(f.ordinal AS INT) AS ordinal, f.feature, (SELECT count(*) FROM processed) AS n_rows "
        f"FROM (VALUES {values}) f(ordinal, feature)"))


@register("feature_columns", _feature_columns_sql())
def q_feature_columns(spark, sf_dir):
    p = preprocess(load_metrics(spark, sf_dir))
    names = p.feature_columns("cpu_utilization")
    cols = spark.createDataFrame(list(enumerate(names)), "ordinal int, feature string")
    n = p.df.agg(F.count(F.lit(1)).alias("n_rows"))
    return cols.crossJoin(F.broadcast(n))


def split_expr(key: str = "row_key", test_pct: int = 20):
    """Deterministic 80/20 split from the key alone: re-run stable, no global sort."""
    h = F.pmod(F.pmod(F.col(key), F.lit(1000003)) * F.lit(48271), F.lit(2147483647)) % 100
    return F.when(h < test_pct, F.lit("test")).otherwise(F.lit("train"))


SPLIT_SQL = ("CASE WHEN (((row_key % 1000003) * 48271) % 2147483647) % 100 < 20 "
             "THEN 'test' ELSE 'train' END")


@register("train_test_split", S.with_ctes([], f"SELECT row_key, host_id, {SPLIT_SQL} AS split FROM metrics"))
def q_train_test_split(spark, sf_dir):
    return load_metrics(spark, sf_dir).select("row_key", "host_id", split_expr().alias("split"))




# ---------------------------------------------------------------- H. prediction analytics
# Predictions come from least-squares models of the scaled columns, one per target, fitted on the
# training rows.  The target carries measurement noise of its own, since the given cpu load is a linear
# image of the latency.
REF_TIME = "2025-01-01 00:00:00"
TRAIN = "train"
CPU, MEMORY = "cpu_utilization", "memory_usage"
#: Power is a linear image of latency: the fit must find out that one of the two adds nothing.
MODEL_FEATURES = {CPU: ["network_latency", "power_consumption", "disk_io", f"{CPU}_lag1"],
                  MEMORY: ["network_latency", "disk_io", f"{MEMORY}_lag1"]}
NOISE_SQL = "CAST((row_key * 7919) % 1009 AS DOUBLE) / 100.9e0"
SHORT = {CPU: "cpu", MEMORY: "mem"}


def learning_metrics(spark, sf_dir) -> DataFrame:
    """The metrics with independent noise (uniform on 0 to 10) on the cpu load."""
    return load_metrics(spark, sf_dir).withColumn(CPU, F.expr(f"{CPU} + {NOISE_SQL}"))


def fitted_models(p) -> dict[str, leastsq.LinearModel]:
    """One model per target, all from one pass over the training rows: the columns are scaled, so their
    products need no other shift."""
    cols = sorted({c for t, fs in MODEL_FEATURES.items() for c in (t, *fs)})
    n, means, products = leastsq.gram(_split(p.df.withColumn("split", split_expr()), TRAIN), cols, shift=[0.0] * len(cols))
    out = {}
    for target, feats in MODEL_FEATURES.items():
        at = [cols.index(c) for c in (*feats, target)]
        out[target] = leastsq.solve(n, means[at], products[at][:, at], feats, target)
    return out


def prediction_frame(spark, sf_dir) -> DataFrame:
    """Actual and predicted cpu and memory load in original units, and the combined load."""
    p = preprocess(learning_metrics(spark, sf_dir))
    cols = []
    for c, m in fitted_models(p).items():
        cols += [scale.unscaled(F.col(c), c, p.scaler).alias(f"{SHORT[c]}_actual"),
                 scale.unscaled(F.expr(m.sql()), c, p.scaler).alias(f"{SHORT[c]}_pred")]
    j = p.df.select("row_key", "host_id", "timestamp", *cols)
    return j.withColumn("combined", predict.combined_load(F.col("cpu_pred"), F.col("mem_pred")))


_LEARNING = ("learning", f"SELECT * REPLACE ({CPU} + {NOISE_SQL} AS {CPU}) FROM metrics")


def _model_ctes():
    """Processed rows and the weights of both models (power is left to latency)."""
    out = [_LEARNING, *S.processed_ctes("learning")]
    for c in (CPU, MEMORY):
        xs = [x for x in MODEL_FEATURES[c] if x != "power_consumption"]
        out += S.ols3_ctes(SHORT[c], xs, c, "processed", f"{SPLIT_SQL} = '{TRAIN}'")
    return out


def _predicted_sql(c):
    """The scaled prediction of target c."""
    xs, m = [x for x in MODEL_FEATURES[c] if x != "power_consumption"], f"{SHORT[c]}_w"
    return f"({m}.w0 + " + " + ".join(f"{m}.w{i} * {x}" for i, x in enumerate(xs, 1)) + ")"


def _pred_ctes():
    sel = []
    for c, short in SHORT.items():
        sel.append(f"{c} * sc_{c} + mu_{c} AS {short}_actual")
        sel.append(f"{_predicted_sql(c)} * sc_{c} + mu_{c} AS {short}_pred")
    return _model_ctes() + [
        ("pred0", f"SELECT row_key, host_id, timestamp, {', '.join(sel)} FROM processed CROSS JOIN proc_s "
                  "CROSS JOIN cpu_w CROSS JOIN mem_w"),
        ("pred", "SELECT *, CASE WHEN mem_pred IS NULL THEN cpu_pred ELSE (cpu_pred + mem_pred) / 2e0 END "
                 "AS combined FROM pred0"),
    ]


def _z_ctes():
    st = ", ".join(f"avg({S.d(c)}) AS zmu_{c}, sqrt(var_pop({S.d(c)}) * count({c}) / count(*)) AS zsd_{c}"
                   for c in S.NUM)
    zs = ", ".join(f"abs((coalesce({S.d(c)}, zmu_{c}) - zmu_{c}) / nullif(zsd_{c}, 0e0))" for c in S.NUM)
    return [("z_s", f"SELECT {st} FROM metrics"),
            ("zsc0", f"SELECT metrics.*, greatest({zs}) AS anomaly_score FROM metrics CROSS JOIN z_s"),
            ("zsc", "SELECT *, coalesce(anomaly_score > 3e0, false) AS is_anomaly FROM zsc0")]


def zscored(spark, sf_dir) -> DataFrame:
    m = load_metrics(spark, sf_dir)
    return anomaly.zscore_anomalies(m, metric_value_cols(m), 3.0)


_TARGETS = [("cpu", "cpu_actual", "cpu_pred"), ("memory", "mem_actual", "mem_pred")]


def by_target(pf: DataFrame) -> DataFrame:
    """Both targets' values in long form, so that one aggregate serves them."""
    return pf.selectExpr("stack(2, " + ", ".join(f"'{t}', {a}, {p}" for t, a, p in _TARGETS) + ") AS (target, actual, predicted)")


@register("error_original_units", S.rounded(S.with_ctes(_pred_ctes(), " UNION ALL ".join(
    f"SELECT '{t}' AS target, avg(abs({p} - {a})) AS mae, "
    f"round(avg(abs(({a} - {p}) / (abs({a}) + 1e-9))) * 100e0, 3) AS mape FROM pred" for t, a, p in _TARGETS)),
    ["mae"]))
def q_error_original_units(spark, sf_dir):
    # MAPE divides by |actual| + 1e-9; near-zero actuals amplify last-bit differences, so 3 decimals.
    out = predict.error_metrics(by_target(prediction_frame(spark, sf_dir)), "actual", "predicted", ["target"])
    return round_doubles(out.withColumn("mape", F.round("mape", 3)))


@register("prediction_stats", S.rounded(S.with_ctes(_pred_ctes(), " UNION ALL ".join(
    f"SELECT '{t}' AS target, avg({p}) AS mean_prediction, stddev_pop({p}) AS std_prediction FROM pred"
    for t, a, p in _TARGETS)), ["mean_prediction", "std_prediction"]))
def q_prediction_stats(spark, sf_dir):
    return round_doubles(by_target(prediction_frame(spark, sf_dir)).groupBy("target").agg(
        F.avg("predicted").alias("mean_prediction"), F.stddev_pop("predicted").alias("std_prediction")))


def _forecast_sql(final_cols: str, dbl):
    ctes = _pred_ctes() + [
        ("tail", "SELECT host_id, row_key, cpu_pred FROM (SELECT host_id, row_key, cpu_pred, row_number() OVER "
                 "(PARTITION BY host_id ORDER BY row_key DESC) AS k FROM pred) t WHERE k <= 6"),
        ("st0", "SELECT host_id, arg_max(cpu_pred, row_key) AS last_value, arg_min(cpu_pred, row_key) AS first_value, "
                "count(*) AS n FROM tail GROUP BY host_id"),
        ("st", "SELECT host_id, last_value, CASE WHEN n > 1 THEN (last_value - first_value) / (n - 1) ELSE 0e0 END "
               "AS slope FROM st0"),
        ("fc", "SELECT host_id, CAST(i AS INT) AS step, greatest(0e0, least(100e0, last_value + slope * i)) AS value, "
               "slope, CASE WHEN slope > 2e-1 THEN 'increasing' WHEN slope < -2e-1 THEN 'decreasing' "
               "ELSE 'stable' END AS trend FROM st CROSS JOIN range(1, 21) r(i)"),
    ]
    return S.rounded(S.with_ctes(ctes, f"SELECT {final_cols} FROM fc"), dbl)


def _forecast(spark, sf_dir):
    pf = prediction_frame(spark, sf_dir)
    return predict.slope_forecast(pf, ["host_id"], "row_key", "cpu_pred", horizon=20)


@register("slope_forecast", _forecast_sql("host_id, step, value", ["value"]))
def q_slope_forecast(spark, sf_dir):
    return round_doubles(_forecast(spark, sf_dir).select("host_id", "step", "value"))


@register("forecast_trend", _forecast_sql("DISTINCT host_id, slope, trend", ["slope"]))
def q_forecast_trend(spark, sf_dir):
    return round_doubles(_forecast(spark, sf_dir).select("host_id", "slope", "trend").distinct())


@register("time_labels", S.with_ctes([], (
    "SELECT row_key, host_id, CAST(timestamp AS VARCHAR) AS label, 'Interval ' || CAST(row_number() OVER "
    f"({S.W}) AS VARCHAR) AS interval_label FROM metrics")))
def q_time_labels(spark, sf_dir):
    m = with_position(load_metrics(spark, sf_dir).select("row_key", "host_id", "timestamp"),
                      ["host_id"], "row_key", "pos")
    return m.select("row_key", "host_id", predict.time_labels(m, "timestamp", "pos").alias("label"),
                    predict.time_labels(m, None, "pos").alias("interval_label"))


@register("latest_prediction", S.rounded(S.with_ctes(_pred_ctes(), (
    "SELECT host_id, arg_max(cpu_pred, row_key) AS cpu_latest, arg_max(mem_pred, row_key) AS memory_latest, "
    "arg_max(combined, row_key) AS combined_latest FROM pred GROUP BY host_id")),
    ["cpu_latest", "memory_latest", "combined_latest"]))
def q_latest_prediction(spark, sf_dir):
    pf = prediction_frame(spark, sf_dir)
    return round_doubles(pf.groupBy("host_id").agg(
        F.max_by("cpu_pred", "row_key").alias("cpu_latest"), F.max_by("mem_pred", "row_key").alias("memory_latest"),
        F.max_by("combined", "row_key").alias("combined_latest")))


@register("prediction_head_50", S.rounded(S.with_ctes(_pred_ctes(), (
    "SELECT host_id, row_key, cpu_pred, mem_pred FROM (SELECT *, row_number() OVER "
    f"({S.W}) AS k FROM pred) t WHERE k <= 50")), ["cpu_pred", "mem_pred"]))
def q_prediction_head_50(spark, sf_dir):
    pf = prediction_frame(spark, sf_dir).select("host_id", "row_key", "cpu_pred", "mem_pred")
    return round_doubles(first_n_per_entity(pf, ["host_id"], "row_key", 50))


@register("combined_load", S.rounded(S.with_ctes(_pred_ctes(), "SELECT row_key, host_id, combined AS combined_load "
                                                               "FROM pred"), ["combined_load"]))
def q_combined_load(spark, sf_dir):
    return round_doubles(prediction_frame(spark, sf_dir).select("row_key", "host_id",
                                                                F.col("combined").alias("combined_load")))


@register("predictions_summary", S.rounded(S.with_ctes(_pred_ctes() + _z_ctes(), (
    "SELECT (SELECT arg_max(combined, row_key) FROM pred) AS latest_combined, "
    "(SELECT (avg(cpu_pred) + avg(mem_pred)) / 2e0 FROM pred) AS average_confidence, "
    "(SELECT count(*) FROM pred) AS n_predictions, "
    "(SELECT count(*) FILTER (WHERE is_anomaly) FROM zsc) AS anomalies_detected")),
    ["latest_combined", "average_confidence"]))
def q_predictions_summary(spark, sf_dir):
    pf = prediction_frame(spark, sf_dir)
    a = pf.agg(F.max_by("combined", "row_key").alias("latest_combined"),
               ((F.avg("cpu_pred") + F.avg("mem_pred")) / 2.0).alias("average_confidence"),
               F.count(F.lit(1)).alias("n_predictions"))
    z = zscored(spark, sf_dir).agg(F.count_if("is_anomaly").alias("anomalies_detected"))
    return round_doubles(a.crossJoin(z))


@register("predictions_first_10", S.rounded(S.with_ctes(_pred_ctes() + [
    ("f", "SELECT *, CAST(row_number() OVER (ORDER BY row_key) AS INT) AS position FROM pred "
          "ORDER BY row_key LIMIT 10")],
    "SELECT position, 'cpu' AS target, cpu_pred AS prediction FROM f UNION ALL "
    "SELECT position, 'memory', mem_pred FROM f"), ["prediction"]))
def q_predictions_first_10(spark, sf_dir):
    """The first ten predictions of each target."""
    head = prediction_frame(spark, sf_dir).orderBy("row_key").limit(10).withColumn(
        "position", F.row_number().over(Window.orderBy("row_key")))   # <= 10 rows
    return round_doubles(head.selectExpr("position", "stack(2, 'cpu', cpu_pred, 'memory', mem_pred) AS (target, prediction)"))


_HIST_N = 20


@register("prediction_history", S.rounded(S.with_ctes(_pred_ctes() + _z_ctes() + [
    ("h", f"SELECT p.*, z.is_anomaly FROM pred p JOIN zsc z ON p.row_key = z.row_key ORDER BY p.row_key "
          f"LIMIT {_HIST_N}"),
    ("h2", "SELECT *, row_number() OVER (ORDER BY row_key) - 1 AS i FROM h")],
    f"SELECT row_key, TIMESTAMP '{REF_TIME}' - to_minutes(CAST({_HIST_N} - i AS INT)) AS time, "
    "combined AS predicted, cpu_actual AS actual, cpu_pred AS cpu_predicted, cpu_actual, "
    "mem_pred AS memory_predicted, mem_actual AS memory_actual, "
    "CASE WHEN combined < 40 THEN 'Low' WHEN combined < 60 THEN 'Medium' WHEN combined < 80 THEN 'High' "
    "ELSE 'Critical' END AS load_level, is_anomaly AS anomaly, abs(cpu_pred - cpu_actual) AS confidence FROM h2"),
    ["predicted", "actual", "cpu_predicted", "cpu_actual", "memory_predicted", "memory_actual", "confidence"]))
def q_prediction_history(spark, sf_dir):
    pf = prediction_frame(spark, sf_dir)
    z = zscored(spark, sf_dir).select("row_key", "is_anomaly")
    head = pf.orderBy("row_key").limit(_HIST_N)
    # at most 20 rows are broadcast; every row_key is in z, which is then not shuffled
    head = z.join(F.broadcast(head), "row_key").withColumn(
        "i", F.row_number().over(Window.orderBy("row_key")) - 1)   # <= 20 rows
    return round_doubles(head.select(
        "row_key", predict.relative_time(REF_TIME, F.col("i"), _HIST_N).alias("time"),
        F.col("combined").alias("predicted"), F.col("cpu_actual").alias("actual"),
        F.col("cpu_pred").alias("cpu_predicted"), "cpu_actual", F.col("mem_pred").alias("memory_predicted"),
        F.col("mem_actual").alias("memory_actual"), predict.load_level(F.col("combined")).alias("load_level"),
        F.coalesce(F.col("is_anomaly"), F.lit(False)).alias("anomaly"),
        F.abs(F.col("cpu_pred") - F.col("cpu_actual")).alias("confidence")))


_LEVEL_SQL = ("CASE WHEN combined < 40 THEN 'Low' WHEN combined < 60 THEN 'Medium' WHEN combined < 80 THEN 'High' "
              "ELSE 'Critical' END")


@register("load_level", S.with_ctes(_pred_ctes(), f"SELECT row_key, host_id, {_LEVEL_SQL} AS load_level FROM pred"))
def q_load_level(spark, sf_dir):
    pf = prediction_frame(spark, sf_dir)
    return pf.select("row_key", "host_id", predict.load_level(F.col("combined")).alias("load_level"))


@register("load_level_distribution", S.rounded(S.with_ctes(_pred_ctes() + [
    ("lv", f"SELECT {_LEVEL_SQL} AS load_level, count(*) AS count FROM pred GROUP BY 1")],
    "SELECT load_level, count, count * 100e0 / sum(count) OVER () AS share_pct FROM lv"), ["share_pct"]))
def q_load_level_distribution(spark, sf_dir):
    pf = prediction_frame(spark, sf_dir).select(predict.load_level(F.col("combined")).alias("load_level"))
    return round_doubles(predict.level_distribution(pf))


@register("prediction_range", S.rounded(S.with_ctes(_pred_ctes(), (
    "SELECT host_id, min(combined) AS prediction_min, max(combined) AS prediction_max FROM (SELECT *, row_number() "
    f"OVER ({S.W}) AS k FROM pred) t WHERE k <= 50 GROUP BY host_id")), ["prediction_min", "prediction_max"]))
def q_prediction_range(spark, sf_dir):
    head = first_n_per_entity(prediction_frame(spark, sf_dir), ["host_id"], "row_key", 50)
    return round_doubles(head.groupBy("host_id").agg(F.min("combined").alias("prediction_min"),
                                                     F.max("combined").alias("prediction_max")))


@register("series_with_forecast", S.rounded(S.with_ctes(_pred_ctes() + [
    ("tail", "SELECT host_id, row_key, cpu_pred FROM (SELECT host_id, row_key, cpu_pred, row_number() OVER "
             "(PARTITION BY host_id ORDER BY row_key DESC) AS k FROM pred) t WHERE k <= 6"),
    ("st0", "SELECT host_id, arg_max(cpu_pred, row_key) AS last_value, arg_min(cpu_pred, row_key) AS first_value, "
            "count(*) AS n FROM tail GROUP BY host_id"),
    ("st", "SELECT host_id, last_value, CASE WHEN n > 1 THEN (last_value - first_value) / (n - 1) ELSE 0e0 END "
           "AS slope FROM st0"),
    ("cnt", "SELECT host_id, count(*) AS n FROM pred GROUP BY host_id")],
    f"SELECT host_id, 'series' AS kind, row_number() OVER ({S.W}) - 1 AS seq, CAST(timestamp AS VARCHAR) AS label, "
    "cpu_pred AS value FROM pred UNION ALL "
    "SELECT st.host_id, 'forecast', n + i - 1, 'F' || CAST(i AS VARCHAR), "
    "greatest(0e0, least(100e0, last_value + slope * i)) FROM st JOIN cnt ON st.host_id = cnt.host_id "
    "CROSS JOIN range(1, 21) r(i)"), ["value"]))
def q_series_with_forecast(spark, sf_dir):
    # read three times: series, counts and tails
    pf = stored(prediction_frame(spark, sf_dir).select("host_id", "row_key", "timestamp", "cpu_pred"), "predictions")
    series = with_position(pf, ["host_id"], "row_key", "seq")
    s = series.select("host_id", F.lit("series").alias("kind"), "seq",
                      F.col("timestamp").cast("string").alias("label"), F.col("cpu_pred").alias("value"))
    n = pf.groupBy("host_id").agg(F.count(F.lit(1)).alias("n"))
    fc = predict.slope_forecast(pf, ["host_id"], "row_key", "cpu_pred", 20).join(n, "host_id")
    f = fc.select("host_id", F.lit("forecast").alias("kind"), (F.col("n") + F.col("step") - 1).alias("seq"),
                  F.concat(F.lit("F"), F.col("step").cast("string")).alias("label"), "value")
    return round_doubles(s.unionByName(f))


@register("actual_vs_predicted", S.rounded(S.with_ctes(_pred_ctes() + [
    ("lim", "SELECT least(min(cpu_actual), min(cpu_pred)) AS axis_min, "
            "greatest(max(cpu_actual), max(cpu_pred)) AS axis_max FROM pred")],
    "SELECT row_key, cpu_actual AS actual, cpu_pred AS predicted, axis_min, axis_max FROM "
    "(SELECT * FROM pred ORDER BY row_key LIMIT 200) h CROSS JOIN lim"),
    ["actual", "predicted", "axis_min", "axis_max"]))
def q_actual_vs_predicted(spark, sf_dir):
    pf = stored(prediction_frame(spark, sf_dir).select("row_key", "cpu_actual", "cpu_pred"), "predictions")
    lim = pf.agg(F.least(F.min("cpu_actual"), F.min("cpu_pred")).alias("axis_min"),
                 F.greatest(F.max("cpu_actual"), F.max("cpu_pred")).alias("axis_max"))
    head = pf.orderBy("row_key").limit(200).select("row_key", F.col("cpu_actual").alias("actual"),
                                                   F.col("cpu_pred").alias("predicted"))
    return round_doubles(head.crossJoin(F.broadcast(lim)))



# ---------------------------------------------------------------- I. anomaly detection
@register("anomaly_zscore", S.rounded(S.with_ctes(_z_ctes(), "SELECT row_key, host_id, anomaly_score, is_anomaly "
                                                            "FROM zsc"), ["anomaly_score"]))
def q_anomaly_zscore(spark, sf_dir):
    return round_doubles(zscored(spark, sf_dir).select("row_key", "host_id", "anomaly_score", "is_anomaly"))


_TOP_COLS = "row_key AS row_index, anomaly_score, cpu_utilization, memory_usage, network_latency"


@register("anomaly_top_n", S.rounded(S.with_ctes(_z_ctes(), (
    f"SELECT {_TOP_COLS} FROM zsc WHERE is_anomaly ORDER BY anomaly_score DESC, row_key LIMIT 10")),
    ["anomaly_score"]))
def q_anomaly_top_n(spark, sf_dir):
    top = anomaly.top_anomalies(zscored(spark, sf_dir), "row_key", 10)
    return round_doubles(top.select(F.col("row_key").alias("row_index"), "anomaly_score", "cpu_utilization",
                                    "memory_usage", "network_latency"))


@register("anomaly_report", S.rounded(S.with_ctes(_z_ctes() + [
    ("tot", "SELECT count(*) AS total_records, count(*) FILTER (WHERE is_anomaly) AS anomalies_count FROM zsc"),
    ("top", f"SELECT row_number() OVER (ORDER BY anomaly_score DESC, row_key) AS rank, {_TOP_COLS} FROM zsc "
            "WHERE is_anomaly ORDER BY anomaly_score DESC, row_key LIMIT 10")],
    "SELECT 'statistical' AS method, total_records, anomalies_count, "
    "anomalies_count * 100e0 / total_records AS anomaly_percentage, CAST(rank AS INT) AS rank, row_index, "
    "anomaly_score, cpu_utilization, memory_usage, network_latency FROM tot CROSS JOIN top"),
    ["anomaly_percentage", "anomaly_score"]))
def q_anomaly_report(spark, sf_dir):
    z = zscored(spark, sf_dir)
    tot = z.agg(F.count(F.lit(1)).alias("total_records"), F.count_if("is_anomaly").alias("anomalies_count"))
    top = anomaly.top_anomalies(z, "row_key", 10).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("anomaly_score").desc(), "row_key")))  # <= 10 rows
    return round_doubles(tot.crossJoin(top).select(
        F.lit("statistical").alias("method"), "total_records", "anomalies_count",
        (F.col("anomalies_count") * 100.0 / F.col("total_records")).alias("anomaly_percentage"), "rank",
        F.col("row_key").alias("row_index"), "anomaly_score", "cpu_utilization", "memory_usage", "network_latency"))


_VIS = ["cpu_utilization", "memory_usage", "network_latency"]


@register("anomaly_split_samples", S.rounded(S.with_ctes(_z_ctes() + [
    ("lg", " UNION ALL ".join(f"SELECT row_key, is_anomaly, '{c}' AS column_name, {S.d(c)} AS value FROM zsc"
                              for c in _VIS))],
    "SELECT row_key, is_anomaly, column_name, value FROM (SELECT *, row_number() OVER (PARTITION BY column_name, "
    "is_anomaly ORDER BY row_key) AS k FROM lg) t WHERE k <= 100"), ["value"]))
def q_anomaly_split_samples(spark, sf_dir):
    return round_doubles(anomaly.split_samples(zscored(spark, sf_dir), _VIS, "row_key", n=100))


# Series names in the explanation text (fixed values).
_SERIES = [("cpu", "cpu_actual", "CPU usage", 0), ("memory", "mem_actual", "memory usage", 1)]


def series_anomaly_frame(spark, sf_dir, pf: DataFrame | None = None) -> DataFrame:
    """CPU and memory series anomalies per host, both metrics in one long-form pass."""
    pf = with_position(pf if pf is not None else prediction_frame(spark, sf_dir), ["host_id"], "row_key", "index")
    long = pf.select("host_id", "row_key", "index", "timestamp", F.explode(F.array(*[
        F.struct(F.lit(metric).alias("metric"), F.lit(rank).alias("metric_order"), F.lit(label).alias("label"),
                 F.col(col).alias("v")) for metric, col, label, rank in _SERIES])).alias("s")).select(
        "host_id", "row_key", "index", "timestamp", "s.*")
    a = anomaly.series_anomalies(long, ["host_id", "metric"], "v", None,
                                 extra_cols=["metric_order", "label", "row_key", "index", "timestamp"],
                                 salt_col="row_key")
    return a.select("host_id", "metric", "metric_order", "index",
                    F.col("timestamp").cast("string").alias("location"), "value", "z_score", "direction",
                    F.concat(F.lit(anomaly.EXPLAIN_PREFIX), F.col("label"), F.lit(" "),
                             F.col("direction"), F.lit(anomaly.EXPLAIN_SUFFIX)).alias("explanation"))


def _series_ctes():
    parts = []
    for metric, col, label, rank in _SERIES:
        parts.append(
            f"SELECT p.host_id, '{metric}' AS metric, {rank} AS metric_order, idx AS index, "
            f"CAST(timestamp AS VARCHAR) AS location, {col} AS value, abs(({col} - mu) / sd) AS z_score, "
            f"CASE WHEN {col} > mu THEN 'surge' ELSE 'drop' END AS direction, "
            f"'Spike detected due to sudden {label} ' || CASE WHEN {col} > mu THEN 'surge' ELSE 'drop' END || '.' "
            f"AS explanation FROM pidx p JOIN (SELECT host_id, avg({col}) AS mu, stddev_pop({col}) AS sd FROM pred "
            f"GROUP BY host_id) s ON p.host_id = s.host_id WHERE sd >= 1e-9 AND abs(({col} - mu) / sd) > 2.5e0")
    return _pred_ctes() + [
        # position = number of earlier rows of the host (DuckDB 2.0 mis-shifts row_number() - 1 under a filter)
        ("pidx", f"SELECT *, CAST(count(*) OVER ({S.W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) "
                 "AS idx FROM pred"),
        ("sa", " UNION ALL ".join(parts))]


@register("series_anomalies", S.rounded(S.with_ctes(_series_ctes(), (
    "SELECT host_id, metric, index, location, value, z_score, direction, explanation FROM sa")),
    ["value", "z_score"]))
def q_series_anomalies(spark, sf_dir):
    return round_doubles(series_anomaly_frame(spark, sf_dir).drop("metric_order"))


@register("merged_anomalies", S.rounded(S.with_ctes(_series_ctes(), (
    "SELECT host_id, metric, index, value, z_score FROM (SELECT *, row_number() OVER (PARTITION BY host_id "
    "ORDER BY index, metric_order) AS k FROM sa) t WHERE k <= 40")), ["value", "z_score"]))
def q_merged_anomalies(spark, sf_dir):
    sa = series_anomaly_frame(spark, sf_dir)
    top = first_n_per_entity(sa, ["host_id"], [F.col("index"), F.col("metric_order")], 40)
    return round_doubles(top.select("host_id", "metric", "index", "value", "z_score"))


@register("anomalies_by_metric", S.rounded(S.with_ctes(_series_ctes(), (
    "SELECT host_id, metric, index, value, z_score FROM (SELECT *, row_number() OVER (PARTITION BY host_id, metric "
    "ORDER BY index) AS k FROM sa) t WHERE k <= 30")), ["value", "z_score"]))
def q_anomalies_by_metric(spark, sf_dir):
    """The first 30 anomalies of each host and metric."""
    top = first_n_per_entity(series_anomaly_frame(spark, sf_dir), ["host_id", "metric"], "index", 30)
    return round_doubles(top.select("host_id", "metric", "index", "value", "z_score"))


@register("anomaly_overlay", S.rounded(S.with_ctes(_series_ctes() + [
    ("acpu", "SELECT host_id, index, value FROM sa WHERE metric = 'cpu'"),
    ("ov", "SELECT p.host_id, p.idx AS index, CAST(p.timestamp AS VARCHAR) AS label, p.cpu_actual AS value, "
           "a.value AS anomaly_value FROM pidx p LEFT JOIN acpu a ON p.host_id = a.host_id AND p.idx = a.index")],
    # the position filter sits above the join: DuckDB 2.0 shifted row_number() - 1 when it was pushed into pidx
    "SELECT * FROM ov WHERE index + 0 < 120"), ["value", "anomaly_value"]))
def q_anomaly_overlay(spark, sf_dir):
    base = stored(prediction_frame(spark, sf_dir), "predictions")
    pf = first_n_per_entity(base, ["host_id"], "row_key", 120, name="k", keep_rank=True).withColumn(
        "index", F.col("k").cast("long") - 1)
    an = series_anomaly_frame(spark, sf_dir, base).where(F.col("metric") == "cpu").select(
        "host_id", "index", F.col("value").alias("anomaly_value"))
    return round_doubles(pf.join(an, ["host_id", "index"], "left").select(
        "host_id", "index", F.col("timestamp").cast("string").alias("label"), F.col("cpu_actual").alias("value"),
        "anomaly_value"))


@register("anomaly_points", S.rounded(S.with_ctes(_z_ctes() + [
    ("zi", f"SELECT *, row_number() OVER (ORDER BY row_key) - 1 AS position FROM zsc")],
    " UNION ALL ".join(f"SELECT row_key, host_id, position, is_anomaly, '{c}' AS column_name, {S.d(c)} AS value "
                       "FROM zi" for c in _VIS)), ["value"]))
def q_anomaly_points(spark, sf_dir):
    z = with_position(zscored(spark, sf_dir), [], "row_key", "position")
    return round_doubles(anomaly.points_long(z, _VIS, ["row_key", "host_id", "position"]))



# ---------------------------------------------------------------- J. right-sizing and packing
from ..operators import packing, rightsize  # noqa: E402
from ..sources.tables import load_tasks  # noqa: E402

CPU_LIMIT, MEM_LIMIT, HC_ITERS = 9.0, 85.0, 100   # cpu limit low enough to reach the penalty branch
SLOTS, PACK_CPU, PACK_MEM = 3, 80.0, 85.0          # few slots so that some tasks stay unplaced


# The limits and the number of slots that users start with.
USUAL_CPU, USUAL_MEM, USUAL_SLOTS = 80.0, 85.0, 24


def _climbed(spark, sf_dir, trace=False, cpu_limit=CPU_LIMIT, mem_limit=MEM_LIMIT):
    st = rightsize.initial_state(load_metrics(spark, sf_dir), ["host_id"])
    return rightsize.hill_climb(st, "host_id", HC_ITERS, cpu_limit, mem_limit, trace=trace)


def _cost_sql(c, m, p, cpu_limit=CPU_LIMIT, mem_limit=MEM_LIMIT):
    return (f"{p} + CASE WHEN {c} > {cpu_limit!r} THEN ({c} - {cpu_limit!r}) * 2e0 ELSE 0e0 END"
            f" + CASE WHEN {m} > {mem_limit!r} THEN ({m} - {mem_limit!r}) * 2e0 ELSE 0e0 END")


def _hc_ctes(*limits):
    cm, mm, lm = rightsize.CPU_MOVE, rightsize.MEM_MOVE, rightsize.LAT_MOVE
    rc = f"({cm[0]!r} + {cm[1] - cm[0]!r} * u)"
    rm = f"({mm[0]!r} + {mm[1] - mm[0]!r} * u)"
    rl = f"({lm[0]!r} + {lm[1] - lm[0]!r} * u)"
    nb = (f"SELECT host_id, it, cpu, mem, pwr, lat, dio, cost, n_impr, "
          f"CASE WHEN mv = 0 THEN greatest(0e0, cpu * (1e0 - {rc})) ELSE cpu END AS ncpu, "
          f"CASE WHEN mv = 1 THEN greatest(0e0, mem * (1e0 - {rm})) ELSE mem END AS nmem, "
          f"CASE WHEN mv = 0 THEN greatest(0e0, pwr * (1e0 - {rc} * {cm[2]!r})) "
          f"WHEN mv = 1 THEN greatest(0e0, pwr * (1e0 - {rm} * {mm[2]!r})) ELSE pwr END AS npwr, "
          f"CASE WHEN mv = 2 THEN greatest(0e0, lat * (1e0 - {rl})) ELSE lat END AS nlat, "
          f"CASE WHEN mv = 2 THEN greatest(0e0, dio * (1e0 - {rl} * {lm[2]!r})) ELSE dio END AS ndio "
          "FROM (SELECT *, r % 3 AS mv, (r % 1000) / 1e3 AS u FROM (SELECT *, "
          + hashed_sql("CAST(host_id AS BIGINT)", "CAST(it AS BIGINT)", rightsize.DRAW_SALT, "((({0}) % {1} + {1}) % {1})") + " AS r FROM {src}) a) b")
    step = f"SELECT *, {_cost_sql('ncpu', 'nmem', 'npwr', *limits)} AS ncost FROM ({nb}) c"
    init = ", ".join(f"coalesce(avg({S.d(c)}), 0e0) AS {c}" for c in rightsize.STATE_COLS)
    return [
        ("st0", f"SELECT host_id, {init} FROM metrics GROUP BY host_id"),
        ("hc", "SELECT host_id, 0 AS it, cpu_utilization AS cpu, memory_usage AS mem, power_consumption AS pwr, "
               "network_latency AS lat, disk_io AS dio, "
               f"{_cost_sql('cpu_utilization', 'memory_usage', 'power_consumption', *limits)} AS cost, 0 AS n_impr FROM st0 "
               "UNION ALL SELECT host_id, it + 1, CASE WHEN ncost < cost THEN ncpu ELSE cpu END, "
               "CASE WHEN ncost < cost THEN nmem ELSE mem END, CASE WHEN ncost < cost THEN npwr ELSE pwr END, "
               "CASE WHEN ncost < cost THEN nlat ELSE lat END, CASE WHEN ncost < cost THEN ndio ELSE dio END, "
               "CASE WHEN ncost < cost THEN ncost ELSE cost END, n_impr + CASE WHEN ncost < cost THEN 1 ELSE 0 END "
               f"FROM ({step.format(src='hc')}) s WHERE it < {HC_ITERS}"),
        ("steps", step.format(src=f"(SELECT * FROM hc WHERE it < {HC_ITERS})")),
        ("fin", f"SELECT s.*, {_cost_sql('s.cpu_utilization', 's.memory_usage', 's.power_consumption', *limits)} "
                "AS initial_cost, h.cpu AS best_cpu_utilization, h.mem AS best_memory_usage, "
                "h.pwr AS best_power_consumption, h.lat AS best_network_latency, h.dio AS best_disk_io, "
                f"h.cost AS best_cost, h.n_impr AS n_improvements FROM st0 s JOIN hc h ON s.host_id = h.host_id "
                f"AND h.it = {HC_ITERS}"),
    ]


_STATE_DBL = rightsize.STATE_COLS


@register("initial_state", S.rounded(S.with_ctes(_hc_ctes()[:1], "SELECT * FROM st0"), _STATE_DBL))
def q_initial_state(spark, sf_dir):
    return round_doubles(rightsize.initial_state(load_metrics(spark, sf_dir), ["host_id"]))


@register("state_cost", S.rounded(S.with_ctes(_hc_ctes()[:1], (
    f"SELECT host_id, {_cost_sql('cpu_utilization', 'memory_usage', 'power_consumption')} AS cost FROM st0")),
    ["cost"]))
def q_state_cost(spark, sf_dir):
    st = rightsize.initial_state(load_metrics(spark, sf_dir), ["host_id"])
    return round_doubles(st.select("host_id", rightsize.cost_expr(
        F.col("cpu_utilization"), F.col("memory_usage"), F.col("power_consumption"), CPU_LIMIT, MEM_LIMIT)
        .alias("cost")))


_HC_OUT = ["initial_cost", "best_cpu_utilization", "best_memory_usage", "best_power_consumption",
           "best_network_latency", "best_disk_io", "best_cost"]


@register("hill_climb", S.rounded(S.with_ctes(_hc_ctes(), "SELECT host_id, " + ", ".join(_HC_OUT)
                                              + ", n_improvements FROM fin", recursive=True), _HC_OUT))
def q_hill_climb(spark, sf_dir):
    return round_doubles(_climbed(spark, sf_dir).select("host_id", *_HC_OUT, "n_improvements"))


@register("hill_climb_usual_limits", S.rounded(S.with_ctes(
    _hc_ctes(USUAL_CPU, USUAL_MEM), "SELECT host_id, " + ", ".join(_HC_OUT) + ", n_improvements FROM fin", recursive=True), _HC_OUT))
def q_hill_climb_usual_limits(spark, sf_dir):
    out = _climbed(spark, sf_dir, cpu_limit=USUAL_CPU, mem_limit=USUAL_MEM)
    return round_doubles(out.select("host_id", *_HC_OUT, "n_improvements"))


@register("hill_climb_trace", S.rounded(S.with_ctes(_hc_ctes(), (
    "SELECT host_id, CAST(it AS INT) AS iteration, cost AS current_cost, ncost AS neighbor_cost, "
    "ncost < cost AS is_improvement FROM steps"), recursive=True), ["current_cost", "neighbor_cost"]))
def q_hill_climb_trace(spark, sf_dir):
    c = _climbed(spark, sf_dir, trace=True)
    return round_doubles(c.select("host_id", F.explode("trace").alias("t")).select("host_id", "t.*"))


@register("optimization_result", S.rounded(S.with_ctes(_hc_ctes(), (
    "SELECT host_id, greatest(0e0, cpu_utilization - best_cpu_utilization) AS cpu_reduction, "
    "greatest(0e0, memory_usage - best_memory_usage) AS memory_reduction, "
    "greatest(0e0, power_consumption - best_power_consumption) AS power_reduction, best_cost, "
    f"concat_ws(' | ', CASE WHEN best_cpu_utilization > {CPU_LIMIT!r} THEN '{rightsize.CPU_OVER}' "
    f"WHEN best_cpu_utilization < {CPU_LIMIT * 0.6!r} THEN '{rightsize.CPU_LOW}' END, "
    f"CASE WHEN best_memory_usage > {MEM_LIMIT!r} THEN '{rightsize.MEM_OVER}' "
    f"WHEN best_memory_usage < {MEM_LIMIT * 0.7!r} THEN '{rightsize.MEM_LOW}' END) AS recommendations FROM fin"),
    recursive=True), ["cpu_reduction", "memory_reduction", "power_reduction", "best_cost"]))
def q_optimization_result(spark, sf_dir):
    return round_doubles(rightsize.optimization_result(_climbed(spark, sf_dir), ["host_id"], CPU_LIMIT, MEM_LIMIT))


@register("savings_summary", S.rounded(S.with_ctes(_hc_ctes() + _pred_ctes() + [
    ("cur", "SELECT host_id, avg(cpu_pred) AS cpu, avg(mem_pred) AS mem FROM pred GROUP BY host_id")], (
    "SELECT host_id, (cpu + mem) / 2e0 AS current_usage, cpu AS current_cpu_usage, "
    "mem AS current_memory_usage, (best_cpu_utilization + best_memory_usage) / 2e0 AS optimized_usage, "
    "best_cpu_utilization AS optimized_cpu_usage, best_memory_usage AS optimized_memory_usage, "
    "((cpu + mem) / 2e0 - (best_cpu_utilization + best_memory_usage) / 2e0) / "
    "((cpu + mem) / 2e0 + 1e-9) * 100e0 AS potential_savings, "
    "CAST(round_even(greatest(75e0, least(85e0, best_cpu_utilization + 5e0)), 0) AS INT) AS cpu_limit, "
    "CAST(round_even(greatest(80e0, least(90e0, best_memory_usage + 5e0)), 0) AS INT) AS memory_limit "
    "FROM fin JOIN cur USING (host_id)"),
    recursive=True), ["current_usage", "current_cpu_usage", "current_memory_usage", "optimized_usage",
                      "optimized_cpu_usage", "optimized_memory_usage", "potential_savings"]))
def q_savings_summary(spark, sf_dir):
    """Current usage is the mean prediction."""
    current = prediction_frame(spark, sf_dir).groupBy("host_id").agg(F.avg("cpu_pred").alias("cpu_pred"),
                                                                     F.avg("mem_pred").alias("mem_pred"))
    return round_doubles(rightsize.savings(_climbed(spark, sf_dir).join(current, "host_id"), ["host_id"], "cpu_pred", "mem_pred"))


@register("infeasible_tasks", S.with_ctes([S.tasks_cte()], (
    f"SELECT *, CASE WHEN cpu_req > {CPU_LIMIT!r} THEN 'cpu' ELSE 'memory' END AS reason FROM tasks "
    f"WHERE cpu_req > {CPU_LIMIT!r} OR memory_req > {MEM_LIMIT!r}")))
def q_infeasible_tasks(spark, sf_dir):
    return packing.infeasible(load_tasks(spark, sf_dir), cpu_limit=CPU_LIMIT, mem_limit=MEM_LIMIT)


def _ff_ctes(slots=SLOTS):
    rng = f"range(1, {slots + 1})"
    zeros = f"list_transform({rng}, lambda k: 0e0)"
    return [S.tasks_cte(),
            ("t", "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY priority DESC, task_id) AS rn FROM tasks"),
            ("ff", f"SELECT group_id, CAST(0 AS BIGINT) AS rn, {zeros} AS cl, {zeros} AS ml, "
                   "CAST(NULL AS BIGINT) AS task_id, CAST(NULL AS INT) AS slot FROM (SELECT DISTINCT group_id FROM t) g "
                   f"UNION ALL SELECT group_id, rn, list_transform({rng}, lambda k: CASE WHEN k = idx THEN cl[k] + c "
                   f"ELSE cl[k] END), list_transform({rng}, lambda k: CASE WHEN k = idx THEN ml[k] + m ELSE ml[k] END), "
                   "task_id, CAST(idx - 1 AS INT) FROM (SELECT ff.group_id, t.rn, ff.cl, ff.ml, t.task_id, "
                   "t.cpu_req AS c, t.memory_req AS m, list_position(list_transform("
                   f"{rng}, lambda k: ff.cl[k] + t.cpu_req <= {PACK_CPU!r} AND ff.ml[k] + t.memory_req <= "
                   f"{PACK_MEM!r}), true) AS idx FROM ff JOIN t ON t.group_id = ff.group_id AND t.rn = ff.rn + 1) s"),
            ("sched", "SELECT t.group_id, t.task_id, t.cpu_req, t.memory_req, t.priority, ff.slot, t.rn FROM t "
                      "JOIN ff ON t.group_id = ff.group_id AND t.task_id = ff.task_id")]


def _scheduled(spark, sf_dir, slots=SLOTS):
    return packing.first_fit(load_tasks(spark, sf_dir), slots=slots, cpu_limit=PACK_CPU, mem_limit=PACK_MEM)


@register("first_fit_24_slots", S.with_ctes(_ff_ctes(USUAL_SLOTS), (
    "SELECT group_id, task_id, slot IS NOT NULL AS placed, coalesce(slot, -1) AS slot FROM sched"), recursive=True))
def q_first_fit_24_slots(spark, sf_dir):
    s = _scheduled(spark, sf_dir, USUAL_SLOTS)
    return s.select("group_id", "task_id", F.col("slot").isNotNull().alias("placed"),
                    F.coalesce("slot", F.lit(-1)).alias("slot"))


@register("first_fit_schedule", S.with_ctes(_ff_ctes(), (
    "SELECT group_id, task_id, cpu_req, memory_req, priority, slot IS NOT NULL AS placed, "
    "coalesce(slot, -1) AS slot FROM sched"), recursive=True))
def q_first_fit_schedule(spark, sf_dir):
    # unplaced is NULL in the library; shown as -1 plus a flag so both engines type it alike
    s = _scheduled(spark, sf_dir)
    return s.select("group_id", "task_id", "cpu_req", "memory_req", "priority",
                    F.col("slot").isNotNull().alias("placed"), F.coalesce("slot", F.lit(-1)).alias("slot"))


@register("schedule_summary", S.rounded(S.with_ctes(_ff_ctes(), (
    "SELECT group_id, count(slot) AS scheduled_count, count(*) AS total_tasks, "
    "CASE WHEN count(*) > 0 THEN count(slot) * 100e0 / count(*) ELSE 0e0 END AS success_rate, "
    f"CASE WHEN count(slot) > 0 THEN '{packing.SUGGEST_PLACED}' ELSE '{packing.SUGGEST_NONE}' END AS suggestion "
    "FROM sched GROUP BY group_id"), recursive=True), ["success_rate"]))
def q_schedule_summary(spark, sf_dir):
    return round_doubles(packing.schedule_summary(_scheduled(spark, sf_dir)))


@register("slot_loads", S.rounded(S.with_ctes(_ff_ctes(), (
    "SELECT group_id, slot, sum(cpu_req) AS cpu, sum(memory_req) AS memory, count(*) AS n_tasks, "
    "string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY rn) AS task_ids FROM sched WHERE slot IS NOT NULL "
    "GROUP BY group_id, slot"), recursive=True), ["cpu", "memory"]))
def q_slot_loads(spark, sf_dir):
    return round_doubles(packing.slot_loads(_scheduled(spark, sf_dir)))



# ---------------------------------------------------------------- K. alerts and live metrics (batch)
from ..operators import alerts  # noqa: E402

_FEED_SQL = ("SELECT row_key, host_id, timestamp, coalesce(cpu_utilization, 50e0) AS cpu_usage, "
             "coalesce(memory_usage, 60e0) AS memory_usage, coalesce(network_latency, 50e0) AS network_traffic, "
             "'operational' AS status, 'csv_data' AS source FROM metrics")
_ALERT_SQL = " UNION ALL ".join(
    f"SELECT row_key, host_id, timestamp, '{m}' AS metric, '{prefix}' || CAST(CAST(floor({m} + 0.5e0) AS BIGINT) "
    f"AS VARCHAR) || '{unit}' AS message, '{sev}' AS severity FROM feed WHERE {m} > {lim!r}"
    for m, lim, prefix, unit, sev in alerts.ALERT_RULES)
_SUP_CTES = [
    ("feed", _FEED_SQL), ("al0", _ALERT_SQL),
    ("al", "SELECT *, epoch_us(timestamp) AS us, row_number() OVER (PARTITION BY host_id, message "
           "ORDER BY timestamp, row_key) AS rn FROM al0"),
    ("sup", "SELECT host_id, message, rn, row_key, us AS last, true AS kept FROM al WHERE rn = 1 UNION ALL "
            "SELECT a.host_id, a.message, a.rn, a.row_key, CASE WHEN a.us - s.last >= 5000000 THEN a.us ELSE s.last "
            "END, a.us - s.last >= 5000000 FROM sup s JOIN al a ON a.host_id = s.host_id AND a.message = s.message "
            "AND a.rn = s.rn + 1"),
    ("kept", "SELECT a.row_key, a.host_id, a.timestamp, a.metric, a.message, a.severity FROM al a JOIN sup s "
             "ON a.host_id = s.host_id AND a.message = s.message AND a.rn = s.rn WHERE s.kept"),
]


def feed_frame(spark, sf_dir) -> DataFrame:
    return alerts.metric_feed(load_metrics(spark, sf_dir))


def kept_alerts(spark, sf_dir) -> DataFrame:
    al = alerts.threshold_alerts(feed_frame(spark, sf_dir))
    return alerts.suppress(al, ["host_id", "message"], "timestamp", alerts.SUPPRESS_SECONDS, "row_key")


@register("metric_feed", S.with_ctes([], _FEED_SQL))
def q_metric_feed(spark, sf_dir):
    return feed_frame(spark, sf_dir)


@register("metric_fallback", S.rounded(S.with_ctes([], (
    "SELECT host_id, coalesce(avg(cpu_utilization), 50e0) AS cpu_usage, coalesce(avg(memory_usage), 60e0) "
    "AS memory_usage, coalesce(avg(network_latency), 50e0) AS network_traffic, CASE WHEN count(*) > 0 THEN "
    "'operational' ELSE 'waiting_for_data' END AS status, CASE WHEN count(*) > 0 THEN 'dataset_stats' ELSE 'default' "
    "END AS source FROM metrics GROUP BY host_id")), ["cpu_usage", "memory_usage", "network_traffic"]))
def q_metric_fallback(spark, sf_dir):
    return round_doubles(alerts.metric_fallback(load_metrics(spark, sf_dir), ["host_id"]))


def _kpi_sql(c):
    return f"CASE WHEN {c} > 80e0 THEN 'danger' WHEN {c} > 60e0 THEN 'warning' ELSE 'success' END"


@register("kpi_status", S.with_ctes([("feed", _FEED_SQL)], (
    f"SELECT row_key, host_id, {_kpi_sql('cpu_usage')} AS cpu_status, {_kpi_sql('memory_usage')} AS memory_status, "
    f"{_kpi_sql('network_traffic')} AS network_status FROM feed")))
def q_kpi_status(spark, sf_dir):
    f = feed_frame(spark, sf_dir)
    return f.select("row_key", "host_id", alerts.kpi_status(F.col("cpu_usage")).alias("cpu_status"),
                    alerts.kpi_status(F.col("memory_usage")).alias("memory_status"),
                    alerts.kpi_status(F.col("network_traffic")).alias("network_status"))


@register("current_load_level", S.with_ctes([("feed", _FEED_SQL)], (
    "SELECT row_key, host_id, CASE WHEN (cpu_usage + memory_usage) / 2e0 < 40 THEN 'LOW' WHEN (cpu_usage + "
    "memory_usage) / 2e0 < 60 THEN 'MEDIUM' WHEN (cpu_usage + memory_usage) / 2e0 < 80 THEN 'HIGH' ELSE 'CRITICAL' "
    "END AS load_level FROM feed")))
def q_current_load_level(spark, sf_dir):
    f = feed_frame(spark, sf_dir)
    return f.select("row_key", "host_id",
                    alerts.current_load_level(F.col("cpu_usage"), F.col("memory_usage")).alias("load_level"))


@register("threshold_alerts", S.with_ctes([("feed", _FEED_SQL)], _ALERT_SQL))
def q_threshold_alerts(spark, sf_dir):
    return alerts.threshold_alerts(feed_frame(spark, sf_dir))


@register("alert_suppression", S.with_ctes(_SUP_CTES, "SELECT * FROM kept", recursive=True))
def q_alert_suppression(spark, sf_dir):
    return kept_alerts(spark, sf_dir)


@register("last_60_buffer", S.with_ctes([("feed", _FEED_SQL)], (
    "SELECT host_id, row_key, CAST(k AS INT) AS rank, cpu_usage, memory_usage, network_traffic, k <= 20 AS shown "
    "FROM (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY row_key DESC) AS k FROM feed) t WHERE k <= 60")))
def q_last_60_buffer(spark, sf_dir):
    f = feed_frame(spark, sf_dir).select("host_id", "row_key", "cpu_usage", "memory_usage", "network_traffic")
    out = alerts.newest_first(f, ["host_id"], [F.col("row_key").desc()], 60, 20)
    return out.select("host_id", "row_key", "rank", "cpu_usage", "memory_usage", "network_traffic", "shown")


@register("recent_alerts", S.with_ctes(_SUP_CTES, (
    "SELECT host_id, row_key, message, severity, timestamp, CAST(k AS INT) AS rank, k <= 5 AS shown FROM "
    "(SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY timestamp DESC, row_key DESC, message) AS k "
    "FROM kept) t WHERE k <= 20"), recursive=True))
def q_recent_alerts(spark, sf_dir):
    k = kept_alerts(spark, sf_dir)
    out = alerts.newest_first(k, ["host_id"], [F.col("timestamp").desc(), F.col("row_key").desc(), F.col("message")],
                              20, 5)
    return out.select("host_id", "row_key", "message", "severity", "timestamp", "rank", "shown")


def _conf(actual, pred):
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(pred - actual) / (F.abs(actual) + F.lit(1e-9)))


@register("recent_history", S.rounded(S.with_ctes(_pred_ctes() + _z_ctes() + [
    ("hist", "SELECT p.host_id, p.row_key, p.combined, z.is_anomaly, greatest(0e0, 1e0 - abs(p.cpu_pred - p.cpu_actual) "
             "/ (abs(p.cpu_actual) + 1e-9)) AS confidence FROM pred p JOIN zsc z ON p.row_key = z.row_key")],
    f"SELECT host_id, row_key, {_LEVEL_SQL} AS load_level, is_anomaly AS anomaly, round(confidence * 100e0, 1) "
    "AS confidence_pct, CAST(k AS INT) AS rank, k <= 20 AS shown FROM (SELECT *, row_number() OVER (PARTITION BY "
    "host_id ORDER BY row_key DESC) AS k FROM hist) t WHERE k <= 50"), []))
def q_recent_history(spark, sf_dir):
    pf = prediction_frame(spark, sf_dir)
    z = zscored(spark, sf_dir).select("row_key", "is_anomaly")
    h = pf.select(
        "host_id", "row_key", predict.load_level(F.col("combined")).alias("load_level"),
        F.round(_conf(F.col("cpu_actual"), F.col("cpu_pred")) * 100.0, 1).alias("confidence_pct"))
    # only the newest rows of each host are looked up
    out = alerts.newest_first(h, ["host_id"], [F.col("row_key").desc()], 50, 20).join(
        z.withColumnRenamed("is_anomaly", "anomaly"), "row_key")
    return out.select("host_id", "row_key", "load_level", "anomaly", "confidence_pct", "rank", "shown")


LOAD_ALERT_CRIT, LOAD_ALERT_WARN = 33.0, 32.0   # low enough that the test data reaches both branches


@register("predicted_load_alert", S.rounded(S.with_ctes(_pred_ctes() + [
    ("g", "SELECT host_id, avg(cpu_pred) AS avg_cpu, coalesce(avg(mem_pred), 0e0) AS avg_memory FROM pred "
          "GROUP BY host_id"),
    ("g2", "SELECT *, CASE WHEN avg_memory > 0 THEN (avg_cpu + avg_memory) / 2e0 ELSE avg_cpu END AS avg_pred FROM g")],
    f"SELECT host_id, avg_cpu, avg_memory, avg_pred, CASE WHEN avg_pred > {LOAD_ALERT_CRIT!r} THEN 'critical' "
    f"ELSE 'warning' END AS severity, printf('%s predicted load (CPU %.1f%%, Memory %.1f%%): %.1f%%', "
    f"CASE WHEN avg_pred > {LOAD_ALERT_CRIT!r} THEN 'High' ELSE 'Elevated' END, avg_cpu, avg_memory, avg_pred) "
    f"AS message FROM g2 WHERE avg_pred > {LOAD_ALERT_WARN!r}"), ["avg_cpu", "avg_memory", "avg_pred"]))
def q_predicted_load_alert(spark, sf_dir):
    out = alerts.predicted_load_alert(prediction_frame(spark, sf_dir), ["host_id"],
                                      critical=LOAD_ALERT_CRIT, warning=LOAD_ALERT_WARN)
    return round_doubles(out)



# ---------------------------------------------------------------- K. streams (batch twins as oracle)
from ..streaming import feeds  # noqa: E402


def _events(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet"


@register("stream_metric_feed", ORACLE["metric_feed"])
def q_stream_metric_feed(spark, sf_dir):
    return feeds.metric_feed_stream(spark, _events(sf_dir), feeds.Place.fresh(spark, "metric-feed"))


@register("stream_alert_suppression", ORACLE["alert_suppression"])
def q_stream_alert_suppression(spark, sf_dir):
    return feeds.suppressed_alerts_stream(spark, _events(sf_dir), feeds.Place.fresh(spark, "kept-alerts"))


@register("stream_last_60", ORACLE["last_60_buffer"])
def q_stream_last_60(spark, sf_dir):
    return feeds.last_n_stream(spark, _events(sf_dir), feeds.Place.fresh(spark, "last-60"), n=60, show=20)



# ---------------------------------------------------------------- G. regression models (MLlib) and I2
from ..operators import deeptree, iforest, models  # noqa: E402

# The library's defaults.
RF_TREES, RF_DEPTH, GBT_ITERS = 100, 10, 100


def training_frame(spark, sf_dir):
    """Preprocessed rows with the split label, and the pipeline.  Their features are written once to the shared
    folder; scaling them is left to the readers.  Many rows are dealt evenly first, whatever the files' row groups."""
    m = learning_metrics(spark, sf_dir)
    if m.count() > models.MANY_ROWS:
        m = stored(m.repartition(2 * spark.sparkContext.defaultParallelism, ORDER), "learning-metrics")
    p = preprocess(m, store=lambda df: stored(df, "training"))
    return p.df.withColumn("split", split_expr()), p


def _split(df, name):
    return df.where(F.col("split") == name)


_FITTED: dict[tuple, tuple] = {}
CACHES.append(_FITTED)


def fitted_forest(spark, sf_dir, target=CPU):
    """(model, rows, features) of the random forest for a target: one fit per session and table, whatever the
    number of queries that use it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if (*key, target) not in _FITTED:
        rows = next((v[1:3] for k, v in _FITTED.items() if k[:2] == key), None)
        df, p = rows or training_frame(spark, sf_dir)
        feats = p.feature_columns(target)
        m = models.fit(_split(df, TRAIN), feats, target, "random_forest", num_trees=RF_TREES, max_depth=RF_DEPTH)
        _FITTED[(*key, target)] = (m, df, p, feats)
    m, df, _, feats = _FITTED[(*key, target)]
    return m, df, feats


def _linear(spark, sf_dir):
    """Preprocessed rows with their split, and the cpu model."""
    p = preprocess(learning_metrics(spark, sf_dir))
    return p.df.withColumn("split", split_expr()), fitted_models(p)[CPU]


@register("fit_linear", S.rounded(S.with_ctes(_model_ctes(), " UNION ALL ".join(
    [f"SELECT CAST({i} AS INT) AS ordinal, '{x}' AS term, "
     + ("0e0 AS coefficient, TRUE AS dependent" if x == "power_consumption" else
        f"w{[f for f in MODEL_FEATURES[CPU] if f != 'power_consumption'].index(x) + 1} AS coefficient, FALSE AS dependent")
     + " FROM cpu_w" for i, x in enumerate(MODEL_FEATURES[CPU])]
    + [f"SELECT CAST({len(MODEL_FEATURES[CPU])} AS INT), 'intercept', w0, FALSE FROM cpu_w"])), ["coefficient"]))
def q_fit_linear(spark, sf_dir):
    """Weights of the cpu model; the feature that another one determines is reported."""
    return round_doubles(_linear(spark, sf_dir)[1].coefficients(spark))


@register("fit_linear_full")
def q_fit_linear_full(spark, sf_dir):
    """Weights over all features of the pipeline, those derived from the target included."""
    df, p = training_frame(spark, sf_dir)
    return leastsq.fit(_split(df, TRAIN), p.feature_columns(CPU), CPU).coefficients(spark)


@register("fit_random_forest")
def q_fit_random_forest(spark, sf_dir):
    m, df, _ = fitted_forest(spark, sf_dir)
    return models.evaluate(m, _split(df, "test"), CPU).select(F.lit("random_forest").alias("model"), "*")


@register("fit_gbt")
def q_fit_gbt(spark, sf_dir):
    df, p = training_frame(spark, sf_dir)
    m = models.fit(_split(df, TRAIN), p.feature_columns(CPU), CPU, "gradient_boosting", gbt_iter=GBT_ITERS)
    return models.evaluate(m, _split(df, "test"), CPU).select(F.lit("gradient_boosting").alias("model"), "*")


@register("train_score", S.rounded(S.with_ctes(_model_ctes(), "SELECT 'linear' AS model, r2, n FROM cpu_w"), ["r2"]))
def q_train_score(spark, sf_dir):
    """R^2 on the training rows, from the predictions."""
    df, m = _linear(spark, sf_dir)
    out = predict.regression_metrics(m.predict(_split(df, TRAIN)), CPU, "prediction")
    return round_doubles(out.select(F.lit("linear").alias("model"), "r2", "n"))


_ALL_PREDICTED = ("ev", f"SELECT row_key, host_id, {SPLIT_SQL} AS split, {CPU} AS y, {_predicted_sql(CPU)} AS p "
                        "FROM processed CROSS JOIN cpu_w")


@register("regression_metrics", S.rounded(S.with_ctes(_model_ctes() + [_ALL_PREDICTED],
    "SELECT avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse, "
    "1e0 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)) AS r2, count(*) AS n FROM ev WHERE split = 'test'"),
    ["mae", "rmse", "r2"]))
def q_regression_metrics(spark, sf_dir):
    df, m = _linear(spark, sf_dir)
    return round_doubles(predict.regression_metrics(m.predict(_split(df, "test")), CPU, "prediction"))


@register("predict_all", S.rounded(S.with_ctes(_model_ctes() + [_ALL_PREDICTED],
    "SELECT row_key, host_id, split, p AS prediction FROM ev"), ["prediction"]))
def q_predict_all(spark, sf_dir):
    df, m = _linear(spark, sf_dir)
    return round_doubles(m.predict(df).select("row_key", "host_id", "split", "prediction"))


@register("predict_all_forest")
def q_predict_all_forest(spark, sf_dir):
    m, df, _ = fitted_forest(spark, sf_dir)
    return models.predict(m, df, keep=["row_key", "host_id", "split"])


@register("feature_importance_top5")
def q_feature_importance_top5(spark, sf_dir):
    m, _, feats = fitted_forest(spark, sf_dir)
    return models.feature_importance(m, feats, 5)


@register("prediction_samples", S.rounded(S.with_ctes(_model_ctes() + [_ALL_PREDICTED],
    "SELECT row_key, y AS actual, p AS predicted, abs(p - y) AS error FROM ev ORDER BY row_key LIMIT 5"),
    ["actual", "predicted", "error"]))
def q_prediction_samples(spark, sf_dir):
    df, m = _linear(spark, sf_dir)
    return round_doubles(m.predict(df.orderBy("row_key").limit(5)).select(
        "row_key", F.col(CPU).alias("actual"), F.col("prediction").alias("predicted"),
        F.abs(F.col("prediction") - F.col(CPU)).alias("error")))


@register("prediction_samples_forest")
def q_prediction_samples_forest(spark, sf_dir):
    m, df, _ = fitted_forest(spark, sf_dir)
    return models.predict(m, df.orderBy("row_key").limit(5), keep=["row_key", CPU]).select(
        "row_key", F.col(CPU).alias("actual"), F.col("prediction").alias("predicted"),
        F.abs(F.col("prediction") - F.col(CPU)).alias("error"))


@register("train_two_targets")
def q_train_two_targets(spark, sf_dir):
    """CPU always, memory when present: random forest per target, training R^2 and test metrics."""
    parts = []
    for target in (CPU, MEMORY):
        m, df, _ = fitted_forest(spark, sf_dir, target)
        tr = models.evaluate(m, _split(df, TRAIN), target).select(F.col("r2").alias("train_r2"))
        te = models.evaluate(m, _split(df, "test"), target).select("mae", "rmse", "r2", F.col("n").alias("n_test"))
        parts.append(tr.crossJoin(te).select(F.lit(target).alias("target"), F.lit("random_forest").alias("model"),
                                             "train_r2", "mae", "rmse", "r2", "n_test"))
    return parts[0].unionByName(parts[1])


# Counters that tell the rows apart into some thousand cells: a tree needs depth 10 and more for them.
_CELLS = ["thread_count", "process_count"]


@register("deep_tree_fit", S.rounded(S.with_ctes([], (
    f"SELECT row_key, memory_usage AS actual, avg(memory_usage) OVER (PARTITION BY {', '.join(_CELLS)}) AS predicted "
    "FROM metrics WHERE memory_usage IS NOT NULL")), ["predicted"]))
def q_deep_tree_fit(spark, sf_dir):
    """A tree grown to purity without sampling predicts, for each training row, the mean of the rows that
    no feature tells from it."""
    m = load_metrics(spark, sf_dir).where("memory_usage IS NOT NULL")
    f = deeptree.fit(m, _CELLS, MEMORY, "row_key", trees=1, bootstrap=False)
    out = f.predict(m, ["row_key", MEMORY], "row_key", "predicted")
    return round_doubles(out.select("row_key", F.col(MEMORY).alias("actual"), "predicted"))


@register("deep_forest_importance")
def q_deep_forest_importance(spark, sf_dir):
    """Shares of the features in a bagged forest of unlimited depth."""
    df, p = training_frame(spark, sf_dir)
    f = deeptree.fit(_split(df, TRAIN), MODEL_FEATURES[CPU], CPU, "row_key", trees=20)
    return f.importance()


# The forest's parameters (the library's defaults).
IF_TREES, IF_PSI, IF_SEED, IF_SHARE = 100, 256, 42, 0.05


def forest_scored(spark, sf_dir, keep=("row_key", "host_id")) -> DataFrame:
    m = load_metrics(spark, sf_dir)
    return iforest.isolation_forest(m, metric_value_cols(m), contamination=IF_SHARE, n_trees=IF_TREES, psi=IF_PSI,
                                    seed=IF_SEED, keep=list(keep))


def _forest_ctes():
    """Grow the same trees and walk every row down them, a CTE per level (a sample of 256 rows has height 8)."""
    n, height = len(S.NUM), 8
    xs = [f"x{i}" for i in range(n)]
    pmod = "((({0}) % {1} + {1}) % {1})"

    def h(a, b, kind):
        return hashed_sql(a, b, iforest.salt(IF_SEED, kind), pmod)

    fill = ", ".join(f"coalesce({S.d(c)}, f_{c}) AS x{i}" for i, c in enumerate(S.NUM))
    lows, highs = (f"[{', '.join(f'{f}({x}) OVER w' for x in xs)}]" for f in ("min", "max"))
    out = [
        ("if_s", "SELECT " + ", ".join(f"avg({S.d(c)}) AS f_{c}" for c in S.NUM) + ", count(*) AS n FROM metrics"),
        ("if_x", f"SELECT row_key, {fill} FROM metrics CROSS JOIN if_s"),
        ("if_h", f"SELECT t.tree, row_key, {h('row_key', 't.tree', iforest.SAMPLE)} AS r FROM if_x CROSS JOIN range({IF_TREES}) t(tree)"),
        ("if_k", f"SELECT tree, row_key FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY r, row_key) AS k FROM if_h) s "
                 f"WHERE k <= {IF_PSI}"),
        ("if_g0", "SELECT tree, CAST(0 AS BIGINT) AS node, if_x.* FROM if_k JOIN if_x USING (row_key)"),
    ]
    usable = f"list_filter(range({n}), lambda i: hi[CAST(i + 1 AS INT)] > lo[CAST(i + 1 AS INT)])"
    for d in range(height + 1):
        out.append((f"if_m{d}", f"SELECT *, {lows} AS lo, {highs} AS hi, count(*) OVER w AS size FROM if_g{d} "
                                "WINDOW w AS (PARTITION BY tree, node)"))
        leaf = "TRUE" if d == height else "len(us) = 0"
        out.append((f"if_p{d}", f"SELECT *, {leaf} AS leaf, CASE WHEN len(us) > 0 THEN us[CAST(1 + {h('tree', 'node', iforest.FEATURE)} "
                                f"% len(us) AS INT)] END AS f, ({h('tree', 'node', iforest.SPLIT)} + 5e-1) / {PRIME}e0 AS u "
                                f"FROM (SELECT *, {usable} AS us FROM if_m{d}) s"))
        out.append((f"if_q{d}", "SELECT *, lo[CAST(f + 1 AS INT)] + (hi[CAST(f + 1 AS INT)] - lo[CAST(f + 1 AS INT)]) * u AS p "
                                f"FROM if_p{d}"))
        out.append((f"if_n{d}", f"SELECT DISTINCT tree, node, leaf, f, p, size FROM if_q{d}"))
        if d < height:
            out.append((f"if_g{d + 1}", f"SELECT tree, CASE WHEN [{', '.join(xs)}][CAST(f + 1 AS INT)] < p THEN 2 * node + 1 "
                                        f"ELSE 2 * node + 2 END AS node, row_key, {', '.join(xs)} FROM if_q{d} WHERE NOT leaf"))
    # Every row walks down: those at a leaf stop there with the length of their path.
    out.append(("if_w0", f"SELECT row_key, t.tree, CAST(0 AS BIGINT) AS node, [{', '.join(xs)}] AS x FROM if_x CROSS JOIN range({IF_TREES}) t(tree)"))
    c = ("CASE WHEN size > 2 THEN 2e0 * (ln(size - 1e0) + 0.5772156649e0) - 2e0 * (size - 1e0) / size "
         "WHEN size = 2 THEN 1e0 ELSE 0e0 END")
    for d in range(height + 1):
        out.append((f"if_e{d}", f"SELECT row_key, CAST({d * iforest.UNIT} + round({c} * {iforest.UNIT}e0) AS BIGINT) AS len "
                                f"FROM if_w{d} JOIN if_n{d} USING (tree, node) WHERE leaf"))
        if d < height:
            out.append((f"if_w{d + 1}", "SELECT row_key, tree, CASE WHEN x[CAST(f + 1 AS INT)] < p THEN 2 * node + 1 "
                                        f"ELSE 2 * node + 2 END AS node, x FROM if_w{d} JOIN if_n{d} USING (tree, node) WHERE NOT leaf"))
    paths = " UNION ALL ".join(f"SELECT * FROM if_e{d}" for d in range(height + 1))
    cpsi = iforest.c_factor(IF_PSI)
    out.append(("if_t", f"SELECT row_key, pow(2e0, -(sum(len)::DOUBLE / {iforest.UNIT * IF_TREES}e0) / {cpsi!r}::DOUBLE) AS anomaly_score "
                        f"FROM ({paths}) s GROUP BY row_key"))
    out.append(("if_a", f"SELECT m.*, anomaly_score, anomaly_score > (SELECT quantile_cont(anomaly_score, {1 - IF_SHARE!r}) FROM if_t) "
                        "AS is_anomaly FROM if_t JOIN metrics m USING (row_key)"))
    return out


@register("anomaly_isolation_forest", S.rounded(S.with_ctes(
    _forest_ctes(), "SELECT row_key, host_id, anomaly_score, is_anomaly FROM if_a"), ["anomaly_score"]))
def q_anomaly_isolation_forest(spark, sf_dir):
    return round_doubles(forest_scored(spark, sf_dir))


@register("isolation_forest_report", S.rounded(S.with_ctes(_forest_ctes() + [
    ("tot", "SELECT count(*) AS total_records, count(*) FILTER (WHERE is_anomaly) AS anomalies_count FROM if_a"),
    ("top", f"SELECT row_number() OVER (ORDER BY anomaly_score DESC, row_key) AS rank, {_TOP_COLS} FROM if_a "
            "WHERE is_anomaly ORDER BY anomaly_score DESC, row_key LIMIT 10")],
    "SELECT 'isolation_forest' AS method, total_records, anomalies_count, "
    "round(anomalies_count * 100e0 / total_records, 2) AS anomaly_percentage, CAST(rank AS INT) AS rank, row_index, "
    "anomaly_score, cpu_utilization, memory_usage, network_latency FROM tot CROSS JOIN top"), ["anomaly_score"]))
def q_isolation_forest_report(spark, sf_dir):
    """Count and share of the rows that the forest flags, and the ten that score highest."""
    scored = forest_scored(spark, sf_dir)
    tot = scored.agg(F.count(F.lit(1)).alias("total_records"), F.count_if("is_anomaly").alias("anomalies_count"))
    top = anomaly.top_anomalies(scored, "row_key", 10).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("anomaly_score").desc(), "row_key")))  # <= 10 rows
    top = load_metrics(spark, sf_dir).join(F.broadcast(top.drop("host_id")), "row_key")
    return round_doubles(F.broadcast(tot).crossJoin(top).select(
        F.lit("isolation_forest").alias("method"), "total_records", "anomalies_count",
        F.round(F.try_divide(F.col("anomalies_count") * 100.0, F.col("total_records")), 2).alias("anomaly_percentage"),
        "rank", F.col("row_key").alias("row_index"), "anomaly_score", "cpu_utilization", "memory_usage", "network_latency"))


@register("anomaly_summary", S.rounded(S.with_ctes(_series_ctes() + _z_ctes() + _forest_ctes(), (
    "SELECT 'statistical' AS method, (SELECT count(*) FROM sa) AS total_anomalies, "
    "(SELECT count(*) FROM sa WHERE metric = 'cpu') AS cpu_anomalies, "
    "(SELECT count(*) FROM sa WHERE metric = 'memory') AS memory_anomalies, "
    "(SELECT round(count(*) FILTER (WHERE is_anomaly) * 100e0 / count(*), 2) FROM zsc) AS zscore_anomaly_percentage, "
    "(SELECT round(count(*) FILTER (WHERE is_anomaly) * 100e0 / count(*), 2) FROM if_a) AS forest_anomaly_percentage")),
    []))
def q_anomaly_summary(spark, sf_dir):
    sa = series_anomaly_frame(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total_anomalies"), F.count_if(F.col("metric") == "cpu").alias("cpu_anomalies"),
        F.count_if(F.col("metric") == "memory").alias("memory_anomalies"))

    def share(name):
        return F.round(F.try_divide(F.count_if("is_anomaly") * 100.0, F.count(F.lit(1))), 2).alias(name)
    z = zscored(spark, sf_dir).agg(share("zscore_anomaly_percentage"))
    f = forest_scored(spark, sf_dir).agg(share("forest_anomaly_percentage"))
    return sa.crossJoin(z).crossJoin(f).select(
        F.lit("statistical").alias("method"), "total_anomalies", "cpu_anomalies", "memory_anomalies",
        "zscore_anomaly_percentage", "forest_anomaly_percentage")



# ---------------------------------------------------------------- flagship: host health
@register("host_health", S.rounded(S.with_ctes(_series_ctes() + [
    ("hl", "SELECT host_id, count(*) AS n_rows, avg(combined) AS avg_load FROM pred GROUP BY host_id"),
    ("ha", "SELECT host_id, count(*) FILTER (WHERE metric = 'cpu') AS cpu_anomalies, "
           "count(*) FILTER (WHERE metric = 'memory') AS memory_anomalies FROM sa GROUP BY host_id")],
    "SELECT hl.host_id, n_rows, avg_load, CASE WHEN avg_load < 40 THEN 'Low' WHEN avg_load < 60 THEN 'Medium' "
    "WHEN avg_load < 80 THEN 'High' ELSE 'Critical' END AS load_level, coalesce(cpu_anomalies, 0) AS cpu_anomalies, "
    "coalesce(memory_anomalies, 0) AS memory_anomalies FROM hl LEFT JOIN ha ON hl.host_id = ha.host_id"),
    ["avg_load"]))
def q_host_health(spark, sf_dir):
    """Which hosts behave abnormally and how loaded are they: per host rows, mean combined load,
    its level, and the count of CPU / memory series anomalies."""
    pf = stored(prediction_frame(spark, sf_dir), "predictions")
    load = pf.groupBy("host_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("combined").alias("avg_load"))
    an = series_anomaly_frame(spark, sf_dir, pf).groupBy("host_id").agg(
        F.count_if(F.col("metric") == "cpu").alias("cpu_anomalies"),
        F.count_if(F.col("metric") == "memory").alias("memory_anomalies"))
    out = load.join(an, "host_id", "left").select(
        "host_id", "n_rows", "avg_load", predict.load_level(F.col("avg_load")).alias("load_level"),
        F.coalesce("cpu_anomalies", F.lit(0)).alias("cpu_anomalies"),
        F.coalesce("memory_anomalies", F.lit(0)).alias("memory_anomalies"))
    return round_doubles(out)

FLAGSHIP = "host_health"
