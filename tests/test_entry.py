"""Driver contract: entry runs, every query has a name, SQL-checkable ones have an oracle."""

import re

import duckdb
import pytest

import __spark_entry__ as entry

from conftest import SF001

NO_ORACLE = {"fit_linear_full", "fit_random_forest", "fit_gbt", "predict_all_forest", "feature_importance_top5",
             "prediction_samples_forest", "train_two_targets", "deep_forest_importance"}


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "host_id" in df.columns


def test_every_query_has_oracle_unless_not_sql(spark):
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    own = {n for n in qs if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert own - set(sql) == NO_ORACLE


@pytest.mark.parametrize("name", ["host_health", "preprocess_pipeline", "hill_climb", "first_fit_schedule",
                                  "alert_suppression", "series_anomalies", "histogram_30", "fit_linear", "predict_all",
                                  "anomaly_isolation_forest", "deep_tree_fit", "scan_csv_inferred", "savings_summary"])
def test_query_matches_oracle_at_sf0001(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    a = entry.queries()[name](spark, SF001).toPandas()
    b = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    key = lambda df: sorted(tuple("" if v is None or v != v else str(round(v, 5)) if isinstance(v, float)
                                  else str(v) for v in row) for row in df[cols].itertuples(index=False))
    assert key(a) == key(b)


def test_optional_parts_that_cannot_be_imported_are_left_out(monkeypatch):
    def lacking(name):
        raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")
    monkeypatch.setattr(entry.importlib, "import_module", lacking)
    with pytest.warns(UserWarning, match="left out"):
        assert entry._optional("metricspark.llm.queries") is None
