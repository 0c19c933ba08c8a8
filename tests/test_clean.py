"""Edge fixtures for cleaning and scaling (FIXTURES.md section 4)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricspark.functions.columns import nan_to_null
from metricspark.operators import clean, scale


def _df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_all_null_column_stays_null(spark):
    df = _df(spark, [(1, 1.0, None), (2, 3.0, None)], "row_key long, cpu double, mem double")
    out = clean.impute(df, "mean", roles=["row_key"]).orderBy("row_key").collect()
    assert [r.cpu for r in out] == [1.0, 3.0]
    assert all(r.mem is None for r in out)


def test_mean_and_median_fill(spark):
    df = _df(spark, [(1, 1.0), (2, None), (3, 2.0), (4, 10.0)], "row_key long, v double")
    mean = {r.row_key: r.v for r in clean.impute(df, "mean", roles=["row_key"]).collect()}
    med = {r.row_key: r.v for r in clean.impute(df, "median", roles=["row_key"]).collect()}
    assert mean[2] == pytest.approx(13 / 3)
    assert med[2] == pytest.approx(2.0)


def test_drop_removes_rows_with_null_string(spark):
    df = _df(spark, [(1, 1.0, "a"), (2, 2.0, None)], "row_key long, v double, s string")
    assert clean.impute(df, "drop").count() == 1
    assert clean.impute(df, "mean", roles=["row_key"]).count() == 2


def test_unknown_method_raises(spark):
    df = _df(spark, [(1, 1.0)], "row_key long, v double")
    with pytest.raises(ValueError):
        clean.impute(df, "mode")
    with pytest.raises(ValueError):
        clean.handle_outliers(df, "hampel")


def test_iqr_clip_bounds_hold(spark):
    vals = [float(i) for i in range(20)] + [1000.0, -500.0]
    df = _df(spark, [(i, v) for i, v in enumerate(vals)], "row_key long, v double")
    out = [r.v for r in clean.clip_iqr(df, roles=["row_key"]).collect()]
    s = sorted(vals)
    import numpy as np
    q1, q3 = np.percentile(s, 25), np.percentile(s, 75)
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert min(out) == pytest.approx(lo) and max(out) == pytest.approx(hi)
    assert len(out) == len(vals)


def test_rare_status_is_zeroed_by_iqr(spark):
    rows = [(i, 1 if i in (10, 60) else 0) for i in range(100)]
    df = _df(spark, rows, "row_key long, status int")
    out = clean.clip_iqr(df, roles=["row_key"]).collect()
    assert all(r.status == 0.0 for r in out)


def test_constant_column_scales_to_zero(spark):
    df = _df(spark, [(i, 50.0, float(i)) for i in range(5)], "row_key long, cpu double, x double")
    out, model = scale.scale(df, "standard", roles=["row_key"])
    assert all(r.cpu == 0.0 for r in out.collect())
    out2, _ = scale.scale(df, "minmax", roles=["row_key"])
    assert all(r.cpu == 0.0 for r in out2.collect())


def test_inverse_of_scale_is_identity(spark):
    df = _df(spark, [(i, float(i * i) / 7.0) for i in range(30)], "row_key long, v double")
    for method in ("standard", "minmax"):
        out, model = scale.scale(df, method, roles=["row_key"])
        back = scale.inverse_frame(out, model, ["v", "absent"]).orderBy("row_key").collect()
        for i, r in enumerate(back):
            assert r.v == pytest.approx(float(i * i) / 7.0, abs=1e-6)


def test_nan_vs_null_normalised(spark):
    df = _df(spark, [(1, float("nan")), (2, None), (3, 4.0)], "row_key long, v double")
    norm = nan_to_null(df)
    assert norm.where(F.col("v").isNull()).count() == 2
    filled = {r.row_key: r.v for r in clean.impute(norm, "mean", roles=["row_key"]).collect()}
    assert filled[1] == 4.0 and not math.isnan(filled[2])


def test_zscore_replacement_uses_median(spark):
    rows = [(i, 10.0) for i in range(30)] + [(30, 1000.0)]
    df = _df(spark, rows, "row_key long, v double")
    out = {r.row_key: r.v for r in clean.replace_zscore(df, roles=["row_key"], threshold=3.0).collect()}
    assert out[30] == 10.0 and out[0] == 10.0


def test_exact_quantiles_by_selection_equal_percentile(spark):
    from metricspark.functions.quantile import exact_quantiles
    from metricspark.sources.tables import load_metrics
    m = load_metrics(spark, "/root/testdata/sf0.01")
    cols, ps = ["cpu_utilization", "memory_usage", "status"], [0.25, 0.5, 0.75]
    ref = m.agg(*[F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in ps])).alias(c)
                  for c in cols]).first()
    # direct_max=0 forces the distributed selection; small/accuracy force refinement rounds
    got = exact_quantiles(m, cols, ps, small=300, accuracy=50, direct_max=0)
    for c in cols:
        for i, p in enumerate(ps):
            assert got[(c, p)] == pytest.approx(ref[c][i], abs=1e-12)


def test_grouped_exact_fits_equal_percentile(spark):
    from metricspark.sources.tables import load_metrics
    m = load_metrics(spark, "/root/testdata/sf0.01").withColumn("g", F.col("host_id") % 3).select(
        "row_key", "g", "cpu_utilization", "network_latency")
    cols = ["cpu_utilization", "network_latency"]
    ref = {r.g: r for r in m.groupBy("g").agg(
        *[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in cols]).collect()}
    med = clean.impute(m, "median", cols=cols, by=["g"])
    nulls = m.where(F.col("cpu_utilization").isNull()).select("row_key", "g").collect()
    got = {r.row_key: r.cpu_utilization for r in med.collect()}
    assert all(got[r.row_key] == pytest.approx(ref[r.g]["cpu_utilization"][1]) for r in nulls)
    clipped = clean.clip_iqr(m, cols=cols, by=["g"]).groupBy("g").agg(F.max("network_latency").alias("hi")).collect()
    for r in clipped:
        q1, q3 = ref[r.g]["network_latency"][0], ref[r.g]["network_latency"][2]
        assert r.hi <= q3 + 1.5 * (q3 - q1) + 1e-9
    z = clean.replace_zscore(m, cols=cols, by=["g"], threshold=2.0)
    assert z.count() == m.count()


def test_exact_quantiles_with_ties(spark):
    """Columns of few values, one hot value, and hot groups: ties never keep the candidates from shrinking."""
    from metricspark.functions.quantile import exact_quantiles, grouped_exact_quantiles
    df = spark.range(4000).selectExpr(
        "id % 3 = 0 AS g", "cast(id % 2 AS double) AS two", "cast(7 AS double) AS one",
        "if(id % 20 = 0, id / 7.0D, 5.0D) AS hot", "cast(id % 5 AS int) AS few",
        "if(id % 4 = 0, NULL, cast(id % 11 AS double)) AS gaps", "cast(NULL AS double) AS none").cache()
    cols, ps = ["two", "one", "hot", "few", "gaps", "none"], [0.0, 0.25, 0.5, 0.501, 0.75, 0.999, 1.0]
    want = df.agg(*[F.percentile(c, F.array(*map(F.lit, ps))).alias(c) for c in cols]).first()
    got = exact_quantiles(df, cols, ps, small=20, accuracy=100, direct_max=0, max_rounds=12)
    for c in cols:
        for k, p in enumerate(ps):
            assert got[c, p] == (want[c][k] if want[c] is not None else None), (c, p)
    # No value is left to rank where a column has two values, so one candidate is enough.
    assert exact_quantiles(df, ["two"], [0.25, 0.5], small=1, direct_max=0) == {("two", 0.25): 0.0, ("two", 0.5): 0.5}
    with pytest.raises(RuntimeError):
        exact_quantiles(df, ["hot"], [0.999], small=1, accuracy=10, direct_max=0, max_rounds=1)
    some = ["two", "hot", "gaps"]
    want = {r["g"]: r for r in df.groupBy("g").agg(
        *[F.percentile(c, F.array(F.lit(0.5), F.lit(0.999))).alias(c) for c in some]).collect()}
    got = grouped_exact_quantiles(df, ["g"], some, [0.5, 0.999], small=20, accuracy=500, max_rounds=8, salts=2)
    for r in got.collect():
        for i, c in enumerate(some):
            assert [r[f"q_{i}_0"], r[f"q_{i}_1"]] == pytest.approx(want[r["g"]][c], rel=1e-12), (r["g"], c)


def test_one_nan_is_one_missing_value(spark):
    from metricspark.operators import clean
    nan = float("nan")
    df = spark.createDataFrame([(k, nan if k == 0 else None if k == 1 else float(k)) for k in range(20)], "id long, x double")
    filled = {r.id: r.x for r in clean.impute(df, "mean", ["x"]).collect()}
    assert filled[0] == filled[1] == sum(range(2, 20)) / 18 and filled[5] == 5.0
    assert {r.id: r.x for r in clean.impute(df, "median", ["x"]).collect()}[0] == 10.5
    clipped = {r.id: r.x for r in clean.clip_iqr(df, ["x"]).collect()}
    assert clipped[0] is None and clipped[19] == 19.0
    assert {r.id: r.x for r in clean.replace_zscore(df, ["x"], 1.0).collect()}[0] is None
    assert clean.impute(df, "drop").count() == 18
    out, counts = clean.impute_mean_with_counts(df, ["x"])
    assert counts == {"x": 20} and out.where("isnan(x) OR x IS NULL").isEmpty()


def test_ranks_of_an_interval_share_a_sketch_and_counts(spark, monkeypatch):
    from metricspark.functions import quantile
    seen, expr = [], quantile.F.expr
    monkeypatch.setattr(quantile.F, "expr", lambda s: (seen.append(s), expr(s))[1])
    df = spark.range(1000).selectExpr("cast(id AS double) AS a", "cast(id * id AS double) AS b")
    got = quantile.exact_quantiles(df, ["a", "b"], [0.25, 0.75], small=300, accuracy=100, direct_max=0)
    ref = {c: np.percentile([float(i) ** k for i in range(1000)], [25, 75]) for c, k in (("a", 1), ("b", 2))}
    assert got == pytest.approx({(c, p): ref[c][i] for c in ref for i, p in enumerate((0.25, 0.75))})
    counts = [s.rsplit(" AS ", 1)[0] for s in seen if s.startswith("count_if")]
    assert sum("percentile_approx" in s for s in seen) == 2 and len(counts) == len(set(counts))
