"""Stage metrics (E1/E2/D2) - the load tester's metric examples plus quirks."""

import pytest

from rampstat.operators.aggregate import latency_profile, model_summary, run_summary, stage_metrics
from tests.helpers import request_df, schedule_df


@pytest.mark.parametrize("method", ["histogram", "disc"])
def test_empty_stage_gives_zeros_but_keeps_target_and_users(spark, method):
    req = request_df(spark, [{"stage_index": 1}])
    sch = schedule_df(spark, [(0, 10.0, 2, 1.0), (1, 10.0, 2, 1.0)])
    out = {r.stage_index: r for r in stage_metrics(req, sch, method=method).collect()}
    s0 = out[0]
    assert (s0.total_requests, s0.successful, s0.failed) == (0, 0, 0)
    assert s0.avg_latency_ms == 0 and s0.error_rate == 0 and s0.achieved_rps == 0
    assert s0.target_rps == 10.0 and s0.active_users == 2


@pytest.mark.parametrize("method", ["histogram", "disc"])
def test_two_successes_floor_rank(spark, method):
    req = request_df(spark, [{"latency_ms": 150.0}, {"latency_ms": 250.0}])
    sch = schedule_df(spark, [(0, 5.0, 1, 5.0)])
    r = stage_metrics(req, sch, method=method).collect()[0]
    assert r.total_requests == 2 and r.successful == 2 and r.failed == 0
    assert r.avg_latency_ms == 200.0
    # floor rank: sorted[int(2*0.5)] = 250 (not the interpolated 200)
    assert (r.p50_latency_ms, r.p95_latency_ms, r.p99_latency_ms) == (250.0, 250.0, 250.0)
    assert r.error_rate == 0
    assert r.achieved_rps == 2 / 5.0


def test_half_failed(spark):
    req = request_df(spark, [{"latency_ms": 100.0},
                             {"latency_ms": 50.0, "status": "failure", "status_code": 500,
                              "error_type": "api_error"}])
    r = stage_metrics(req, schedule_df(spark, [(0, 5.0, 1, 1.0)])).collect()[0]
    assert (r.successful, r.failed, r.error_rate) == (1, 1, 0.5)


def test_failed_counts_timeouts_and_errors_and_3xx_is_success(spark):
    req = request_df(spark, [
        {"status": "success", "status_code": 302},
        {"status": "timeout", "status_code": None, "latency_ms": 0.0, "error_type": "timeout"},
        {"status": "error", "status_code": None, "latency_ms": 0.0, "error_type": "ConnectError"},
        {"status": "failure", "status_code": 429},
    ])
    r = stage_metrics(req, schedule_df(spark, [(0, 5.0, 1, 1.0)])).collect()[0]
    assert (r.total_requests, r.successful, r.failed) == (4, 1, 3)
    # zero latencies of timeouts/errors are part of the mean (Q2)
    assert r.avg_latency_ms == pytest.approx((100.0 + 0 + 0 + 100.0) / 4)


def test_elapsed_is_floored_at_one_millisecond(spark):
    req = request_df(spark, [{}])
    r = stage_metrics(req, schedule_df(spark, [(0, 5.0, 1, 0.0)])).collect()[0]
    assert r.achieved_rps == pytest.approx(1 / 0.001)


def test_model_summary_first_seen_order_and_rates(spark):
    req = request_df(spark, [{"model": "b"}, {"model": "a", "status": "failure", "status_code": 500},
                             {"model": "b", "latency_ms": 300.0}])
    out = {r.model: r for r in model_summary(req).collect()}
    assert out["b"].first_seq == 1 and out["a"].first_seq == 2
    assert out["a"].success_rate == 0.0 and out["b"].success_rate == 1.0
    # model sheet p50 = latencies[len // 2]
    assert out["b"].p50_latency_ms == 300.0
    assert model_summary(req, use_seq=True).count() == 2


def test_run_summary_cards(spark):
    req = request_df(spark, [{"latency_ms": 10.0}, {"latency_ms": 20.0, "status": "error",
                                                    "status_code": None, "error_type": "X"}])
    r = run_summary(req).collect()[0]
    assert (r.total_requests, r.successful, r.failed, r.avg_latency_ms) == (2, 1, 1, 15.0)


def test_latency_profile_methods_agree(spark):
    import random
    rnd = random.Random(3)
    rs = [{"stage_index": rnd.randint(0, 3), "latency_ms": float(rnd.randint(0, 40))} for _ in range(500)]
    req = request_df(spark, rs)
    a = sorted(map(tuple, latency_profile(req, ["run_id", "stage_index"], "histogram").collect()))
    b = sorted(map(tuple, latency_profile(req, ["run_id", "stage_index"], "disc").collect()))
    assert a == b


def test_success_only_profiles(spark):
    from rampstat.operators.aggregate import latency_profile
    df = spark.createDataFrame([(0, "success", 10.0), (0, "timeout", 0.0), (0, "success", 30.0), (1, "error", 0.0)],
                               "run_id long, status string, latency_ms double")
    got = {r.run_id: tuple(r)[1:6] for r in latency_profile(df, ["run_id"], success_only=True).collect()}
    assert got == {0: (3, 2, 1, 20.0, 30.0), 1: (1, 0, 1, 0.0, 0.0)}


def test_prompt_id_of_another_column(spark):
    from pyspark.sql import functions as F
    from rampstat.functions.text import parse_prompt_id
    row = spark.sql("SELECT 'zzz-9' AS prompt_id, 'math-3' AS own, 'plain' AS bare, 'x-y' AS bad")
    got = row.select(*[parse_prompt_id(F.col(c)).alias(c) for c in row.columns]).first()
    assert [(v.suite, v["index"]) for v in got] == [("zzz", 8), ("math", 2), ("plain", 0), ("x", None)]
