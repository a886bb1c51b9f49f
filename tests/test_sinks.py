"""Request-log source and report-bundle sinks."""

import os
import tempfile

from rampstat.schema import REQUEST
from rampstat.sources.request_log import (
    BUNDLE_PARTS, empty_like, read_request_log, write_report_bundle, write_request_log,
)
from tests.helpers import request_df


def test_log_round_trip_partitioned_by_run(spark):
    d = tempfile.mkdtemp(prefix="log-", dir="/tmp")
    req = request_df(spark, [{"run_id": 1}, {"run_id": 2}, {"run_id": 2}]).drop("event_id")
    write_request_log(req, d)
    assert sorted(os.listdir(d))[:2] == ["._SUCCESS.crc", "_SUCCESS"] or "run_id=1" in os.listdir(d)
    back = read_request_log(spark, d)
    assert back.schema.fieldNames() == REQUEST.fieldNames() or set(back.columns) == set(REQUEST.fieldNames())
    plan = back.where("run_id = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert back.where("run_id = 2").count() == 2


def test_bundle_written_in_order(spark):
    d = tempfile.mkdtemp(prefix="bundle-", dir="/tmp")
    req = request_df(spark, [{}])
    parts = {name: req.select("run_id", "seq") for name in reversed(BUNDLE_PARTS)}
    paths = write_report_bundle(d, parts)
    assert [p.rsplit("/", 1)[1] for p in paths] == BUNDLE_PARTS
    assert spark.read.parquet(paths[0]).count() == 1


def test_empty_result_is_typed(spark):
    e = empty_like(spark, REQUEST)
    assert e.count() == 0 and e.schema == REQUEST


def _bundles(spark):
    from rampstat.sources.request_log import ReportBundles
    return ReportBundles(spark, tempfile.mkdtemp(prefix="bundles-", dir="/tmp"))


def _parts(spark, n):
    req = request_df(spark, [{"run_id": k % 3, "latency_ms": float(n)} for k in range(n)])
    return {name: req.select("run_id", "seq", "latency_ms", "stage_index") for name in BUNDLE_PARTS}


def test_a_bundle_is_seen_whole_or_not_at_all(spark):
    import pytest
    b = _bundles(spark)
    with pytest.raises(FileNotFoundError):
        b.parts()
    assert b.commit(_parts(spark, 4)) == 0
    old = b.parts()
    assert list(old) == BUNDLE_PARTS and all(df.count() == 4 for df in old.values())
    assert old["errors"].schema["run_id"].dataType.simpleString() == "bigint"  # as written, not as the folder names suggest
    broken = _parts(spark, 6)
    broken["errors"] = broken["errors"].selectExpr("run_id", "CAST(raise_error('lost') AS BIGINT) AS seq", "latency_ms", "stage_index")
    with pytest.raises(Exception, match="lost"):
        b.commit(broken)  # four tables of it are written
    assert all(df.count() == 4 for df in b.parts().values())
    assert b.commit(_parts(spark, 7)) == 2
    assert all(df.count() == 7 for df in b.parts().values())
    assert all(df.count() == 4 for df in b.parts(0).values()) and old["config"].count() == 4  # still there for its readers


def test_old_bundles_go(spark):
    b = _bundles(spark)
    for n in range(1, 5):
        b.commit(_parts(spark, n))
    assert b.versions() == [2, 3]
    assert sorted(x for x in os.listdir(b.root) if x.startswith("bundle=")) == ["bundle=000002", "bundle=000003"]


def test_a_run_has_few_files(spark):
    d = tempfile.mkdtemp(prefix="log-", dir="/tmp")
    req = request_df(spark, [{"run_id": k % 2} for k in range(500)]).repartition(40)
    write_request_log(req, d)
    assert len([f for f in os.listdir(f"{d}/run_id=1") if f.endswith(".parquet")]) <= 2
