"""H1, E6/E7, H5, D1, C3, H2 - report tables."""

from rampstat.operators.aggregate import scale_info
from rampstat.operators.report import (
    config_key_values, error_report, off_scale_marks, raw_report, rate_series,
)
from tests.helpers import request_df


def stage_rows(spark, target, achieved, n=15):
    return spark.createDataFrame([(0, 0, target, achieved, 2, n)],
                                 "run_id bigint, stage_index int, target_rps double, achieved_rps double, "
                                 "active_users int, total_requests long")


def test_rate_series_in_rpm(spark):
    out = {r.series: r.rpm for r in rate_series(stage_rows(spark, 2.0, 1.5)).collect()}
    assert out == {"Target RPM": 120.0, "Achieved RPM": 90.0}


def test_scale_uses_achieved_above_10x(spark):
    r = scale_info(stage_rows(spark, 10.0, 0.5)).first()
    assert r.use_achieved_scale is True and r.target_max == 600.0 and r.achieved_max == 30.0
    marks = {m.kind: m for m in off_scale_marks(scale_info(stage_rows(spark, 10.0, 0.5))).collect()}
    assert marks["note"].note == "Target peak: 600.00 RPM (off-scale)"
    assert marks["marker"].rpm == 34.5 and marks["note"].rpm == 34.5 * 0.98


def test_scale_normal_below_threshold(spark):
    r = scale_info(stage_rows(spark, 2.0, 1.0)).first()
    assert r.use_achieved_scale is False and r.y_max == 120.0
    assert off_scale_marks(scale_info(stage_rows(spark, 2.0, 1.0))).count() == 0


def test_scale_with_nothing_achieved(spark):
    r = scale_info(stage_rows(spark, 2.0, 0.0)).first()
    assert r.use_achieved_scale is True and r.y_max == 1.0


def test_raw_report_rounding_and_missing_stage(spark):
    req = request_df(spark, [{"latency_ms": 123.456, "stage_index": 3, "target_rps": 1.0 / 3}])
    stages = stage_rows(spark, 1.0, 0.7)
    r = raw_report(req, stages, unit="rpm").first()
    assert r.latency_ms == 123.46 and r.target_rpm == 20.0 and r.achieved_rpm == 0.0
    assert r.error_type == ""


def test_error_report_leaves_http_failures_out_by_default(spark):
    req = request_df(spark, [{"status": "failure", "status_code": 500},
                             {"status": "timeout", "status_code": None, "error_type": "timeout"}])
    assert error_report(req).count() == 1
    assert error_report(req, include_http_failures=True).count() == 2


def test_config_key_values_fixed_order(spark):
    df = spark.createDataFrame(
        [(7, "http://x", "v1/chat", "rpm", 1 / 60, 2.0, 2.0, 10.0, 1, 3, 1, "coding", 60.0,
          [("m", 1.0)], [])],
        "run_id bigint, base_url string, api_path string, rate_unit string, initial_rate double, "
        "max_rate double, scaling_factor double, time_increment double, min_users int, max_users int, "
        "users_increment int, benchmark_suite string, timeout double, "
        "models array<struct<model:string,percentage:double>>, tokens array<struct<token:string,label:string>>")
    kv = [(r.ordinal, r.key, r.value) for r in config_key_values(df).orderBy("ordinal").collect()]
    assert len(kv) == 14 and kv[0] == (1, "base_url", "http://x")
    assert kv[3] == (4, "initial_rate_rps", "0.016667") and kv[-2:] == [(13, "model_count", "1"),
                                                                        (14, "token_count", "0")]


def test_bundle_counts_credentials_without_lists(spark):
    from types import SimpleNamespace

    from rampstat.plans.bundle import run_configurations
    from rampstat.sources import fixtures as fx

    users = spark.createDataFrame([(k % 2, k, f"user-{k}") for k in range(7)], "run_id long, token_index long, raw_label string")
    runs = fx.configured_runs(users.select("run_id").distinct())
    configs = run_configurations(SimpleNamespace(users=users, runs=runs, tokens=lambda: fx.run_tokens(users)))
    plan = configs._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "partial_count" in configs._jdf.queryExecution().executedPlan().toString()
    got = {r.run_id: r.value for r in config_key_values(configs).where("key = 'token_count'").collect()}
    assert got == {0: "4", 1: "3"}
