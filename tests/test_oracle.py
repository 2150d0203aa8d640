"""Registered queries against their SQL on the smallest tables. VIGIL_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"
QUICK = [
    "scan_unpivot", "minute_rollup", "pivot_signal", "z_matrix", "minute_score", "alert_runs", "label_alerts", "normal_minutes", "detector_sweep",
    "operating_point", "burn_alerts", "slo_status", "rolling_budget", "sustained_alert", "feature_rows", "evidence", "incident_context", "class_report",
    "confusion_matrix", "explain", "tune_cutoff", "robust_scale", "knn_novelty", "psi", "feature_drift", "quiet_window", "gate_checks", "counter_increase",
    "latency_quantile", "load_documents", "chunk_documents", "sentence_split", "topk_retrieval", "extractive_answers", "tune_refusal", "stream_ingest",
    "stream_minute_rollup", "stream_ewma", "csv_roundtrip", "report_json",
]
ORACLE = entry.oracle_sql()
NAMES = sorted(ORACLE) if os.environ.get("VIGIL_ALL") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got, columns = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[name])
    want, expected = rows([c[0] for c in cur.description], cur.fetchall())
    assert columns == expected
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["fired_at", "started_at", "ended_at", "service", "signal", "peak"]
