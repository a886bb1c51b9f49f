"""Driver contract: entry, query registry, oracle parity on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as E
from rampstat.plans.queries import QUERIES
from tests.conftest import SF001

TABLES = ["customer", "events", "benchmark"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 40
    assert "p99_latency_ms" in df.columns


def test_every_sql_key_is_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    # every query of the library's own has SQL; the optional llm queries may have none
    assert set(QUERIES) <= set(o)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    return round(v, 9) if isinstance(v, float) else (v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)


@pytest.mark.parametrize("name", ["stage_metrics", "model_summary", "multi_grain_rollup", "raw_report",
                                  "progress_running", "config_audit", "ramp_schedule",
                                  "assign_credential", "credential_rejects", "percentiles_disc", "approx_percentiles"])
def test_parity_with_sql(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = df.columns
    got = sorted(tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    idx = [dcols.index(c) for c in sorted(cols)]
    exp = sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert sorted(dcols) == sorted(cols)
    assert got == exp


def test_no_row_at_a_time_python_in_plans(spark):
    for name in ["stage_metrics", "raw_report", "config_audit"]:
        plan = E.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scan_is_pruned(spark):
    from rampstat.plans.queries import q_run_summary
    plan = q_run_summary(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    # of the stored log the summary reads run, status and latency, never more
    assert scans and all(ln.split("ReadSchema: struct<")[1].split(">")[0] in ("run_id:bigint,status:string,latency_ms:double",) for ln in scans), scans


def test_raw_report_joins_stages_by_broadcast(spark):
    df = E.queries()["raw_report"](spark, SF001)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
