"""ANSI-SQL statements (DuckDB dialect) of the registered plans, used as the
independent oracle.  Built from the same column lists as the Spark plans; the
arithmetic is written out again, not shared."""

from __future__ import annotations

from ..sources.tables import METRICS_SQL, TASKS_SQL

ROLES = ["row_key", "host_id"]
NUM = ["cpu_utilization", "memory_usage", "network_latency", "power_consumption", "disk_io",
       "thread_count", "process_count", "uptime", "status"]
ALL = ["row_key", "host_id", "timestamp", *NUM]
FEAT_SRC = [c for c in NUM if c != "status"]
RATIOS = [("cpu_memory_ratio", "cpu_utilization", "memory_usage"),
          ("io_latency_ratio", "disk_io", "network_latency"),
          ("thread_process_ratio", "thread_count", "process_count")]
W = "PARTITION BY host_id ORDER BY row_key"


def d(c: str) -> str:
    return f"CAST({c} AS DOUBLE)"


def with_ctes(ctes: list[tuple[str, str]], final: str, recursive: bool = False) -> str:
    parts = [("metrics", METRICS_SQL)] + ctes
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({s})" for n, s in parts) + "\n" + final


def tasks_cte() -> tuple[str, str]:
    return ("tasks", TASKS_SQL)


def rounded(sql: str, cols: list[str], digits: int = 6) -> str:
    if not cols:
        return sql
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) AS rnd"


def imputed_ctes(src: str = "metrics", name: str = "imputed", cols=NUM, agg: str = "mean") -> list[tuple[str, str]]:
    if agg == "mean":
        stats = ", ".join(f"avg({d(c)}) AS f_{c}" for c in cols)
    else:
        stats = ", ".join(f"quantile_cont({d(c)}, 0.5) AS f_{c}" for c in cols)
    sel = ", ".join(f"coalesce({d(c)}, f_{c}) AS {c}" if c in cols else c for c in ALL)
    return [(f"{name}_s", f"SELECT {stats} FROM {src}"),
            (name, f"SELECT {sel} FROM {src} CROSS JOIN {name}_s")]


def clipped_ctes(src: str = "imputed", name: str = "clipped", cols=NUM, t: str = "1.5e0") -> list[tuple[str, str]]:
    stats = ", ".join(f"quantile_cont({d(c)}, 0.25) AS q1_{c}, quantile_cont({d(c)}, 0.75) AS q3_{c}"
                      for c in cols)
    sel = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE greatest(q1_{c} - {t} * (q3_{c} - q1_{c}), "
        f"least(q3_{c} + {t} * (q3_{c} - q1_{c}), {d(c)})) END AS {c}" if c in cols else c for c in ALL)
    return [(f"{name}_s", f"SELECT {stats} FROM {src}"),
            (name, f"SELECT {sel} FROM {src} CROSS JOIN {name}_s")]


def rolling_sql(cols, window: int = 3) -> list[str]:
    fr = f"({W} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    out = []
    for c in cols:
        out.append(f"avg({d(c)}) OVER {fr} AS {c}_rolling_avg")
        out.append(f"coalesce(stddev_samp({d(c)}) OVER {fr}, 0e0) AS {c}_rolling_std")
    for c in cols:
        out.append(f"coalesce(lag({c}, 1) OVER ({W}), {c}) AS {c}_lag1")
    return out


def ratio_sql(present=None) -> list[str]:
    present = set(present or ALL)
    return [f"{d(a)} / ({d(b)} + 1e-9) AS {n}" for n, a, b in RATIOS if a in present and b in present]


def feature_names(cols=FEAT_SRC) -> list[str]:
    out = []
    for c in cols:
        out += [f"{c}_rolling_avg", f"{c}_rolling_std"]
    out += [f"{c}_lag1" for c in cols]
    return out + [n for n, _, _ in RATIOS]


def ols3_ctes(name: str, xs: list[str], y: str, src: str, where: str) -> list[tuple[str, str]]:
    """``{name}_w``: intercept w0, weights w1 to w3 and r2 of the least squares of y on three columns, by
    Cramer's rule on their covariances."""
    a, b, c = xs
    cov = {"a12": (a, b), "a13": (a, c), "a23": (b, c), "b1": (a, y), "b2": (b, y), "b3": (c, y)}
    sums = [f"avg({x}) AS m{i}, var_pop({x}) AS a{i}{i}" for i, x in enumerate(xs, 1)]
    sums += [f"covar_pop({u}, {v}) AS {n}" for n, (u, v) in cov.items()]
    det = "(a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13))"
    w = ["(b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3))",
         "(a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13))",
         "(a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13))"]
    return [(f"{name}_g", f"SELECT {', '.join(sums)}, avg({y}) AS my, var_pop({y}) AS vy, count(*) AS n FROM {src} WHERE {where}"),
            (f"{name}_v", f"SELECT *, " + ", ".join(f"{e} / {det} AS w{i}" for i, e in enumerate(w, 1)) + f" FROM {name}_g"),
            (f"{name}_w", "SELECT my - w1 * m1 - w2 * m2 - w3 * m3 AS w0, w1, w2, w3, "
                          f"(w1 * b1 + w2 * b2 + w3 * b3) / vy AS r2, n FROM {name}_v")]


def processed_ctes(src: str = "metrics") -> list[tuple[str, str]]:
    """impute mean -> IQR 1.5 -> features -> residual fill + standard scale (population)."""
    feats = feature_names()
    num_all = NUM + feats
    scale_cols = [c for c in num_all if c != "status"]
    stats = []
    for c in scale_cols:
        sd = f"sqrt(var_pop({d(c)}) * count({c}) / count(*))"
        stats.append(f"avg({d(c)}) AS mu_{c}, CASE WHEN {sd} = 0 THEN 1e0 ELSE {sd} END AS sc_{c}")
    stats.append(f"avg({d('status')}) AS mu_status")
    sel = ["row_key", "host_id", "timestamp"]
    for c in num_all:
        if c in scale_cols:
            sel.append(f"(coalesce({d(c)}, mu_{c}) - mu_{c}) / sc_{c} AS {c}")
        else:
            sel.append(f"coalesce({d(c)}, mu_{c}) AS {c}")
    return (imputed_ctes(src) + clipped_ctes() + [
        ("feat", f"SELECT *, {', '.join(rolling_sql(FEAT_SRC) + ratio_sql())} FROM clipped"),
        ("proc_s", f"SELECT {', '.join(stats)} FROM feat"),
        ("processed", f"SELECT {', '.join(sel)} FROM feat CROSS JOIN proc_s"),
    ])


def processed_columns() -> list[str]:
    return ["row_key", "host_id", "timestamp"] + NUM + feature_names()


def processed_doubles() -> list[str]:
    return NUM + feature_names()
