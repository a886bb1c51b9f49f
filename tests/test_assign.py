"""Assignment of requests."""

import datetime as dt

from pyspark.sql import functions as F

from rampstat.operators.assign import (
    allocated_rates, assign_credential, assign_duplicate, assign_prompt, assign_round_robin,
    assign_stage, assign_weighted,
)
from tests.helpers import T0, request_df, schedule_df

MODELS = "array<struct<model:string,percentage:double>>"


def runs_df(spark, models, run_id=0):
    df = spark.createDataFrame([(run_id, models, T0)],
                               f"run_id bigint, models {MODELS}, started_at timestamp")
    return df


def test_round_robin_over_active_models(spark):
    req = request_df(spark, [{"seq": 0}, {"seq": 1}, {"seq": 2}])
    runs = runs_df(spark, [("a", 50.0), ("b", 50.0)])
    got = sorted((r.seq, r.assigned_model) for r in assign_round_robin(req, runs).collect())
    assert got == [(0, "a"), (1, "b"), (2, "a")]


def test_inactive_models_skipped_and_fallback_to_first(spark):
    req = request_df(spark, [{"seq": 1}, {"seq": 2}])
    got = {r.seq: r.assigned_model for r in
           assign_round_robin(req, runs_df(spark, [("a", 0.0), ("b", 40.0), ("c", 60.0)])).collect()}
    assert got == {1: "c", 2: "b"}
    got = {r.seq: r.assigned_model for r in
           assign_round_robin(req, runs_df(spark, [("z", 0.0), ("y", 0.0)])).collect()}
    assert got == {1: "z", 2: "z"}


def test_weighted_split(spark):
    req = request_df(spark, [{"seq": s} for s in range(200)])
    out = assign_weighted(req, runs_df(spark, [("a", 70.0), ("b", 30.0), ("c", 0.0)]))
    cnt = {r.assigned_model: r["count"] for r in out.groupBy("assigned_model").count().collect()}
    assert cnt == {"a": 140, "b": 60}


def test_duplicate_mode(spark):
    req = request_df(spark, [{"seq": 1}, {"seq": 2}])
    out = assign_duplicate(req, runs_df(spark, [("a", 100.0), ("b", 100.0), ("c", 20.0)]))
    assert sorted((r.seq, r.assigned_model) for r in out.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b")]


def test_credentials_round_robin_label_default_and_public(spark):
    req = request_df(spark, [{"seq": s} for s in (1, 2, 3)])
    toks = spark.createDataFrame([(0, 0, "t0", "alice"), (0, 1, "t1", "")],
                                 "run_id bigint, token_pos long, token string, label string")
    got = {r.seq: (r.token_idx, r.assigned_label) for r in assign_credential(req, toks).collect()}
    assert got == {1: (1, "user-1"), 2: (0, "alice"), 3: (1, "user-1")}
    none = spark.createDataFrame([], "run_id bigint, token_pos long, token string, label string")
    got = {r.seq: (r.token_idx, r.assigned_label) for r in assign_credential(req, none).collect()}
    assert got == {1: (0, "public"), 2: (0, "public"), 3: (0, "public")}


def test_prompt_wraps_and_empty_suite(spark):
    req = request_df(spark, [{"seq": 1, "suite_id": "math"}, {"seq": 5, "suite_id": "math"},
                             {"seq": 2, "suite_id": "text_processing"}])
    prompts = spark.createDataFrame([("math", 0, "p0"), ("math", 1, "p1"), ("math", 2, "p2")],
                                    "suite_id string, prompt_index long, text string")
    got = {r.seq: (r.assigned_prompt_id, r.prompt_text) for r in assign_prompt(req, prompts).collect()}
    assert got == {1: ("math-2", "p1"), 5: ("math-3", "p2"), 2: (None, "")}


def test_stage_assignment_variable_durations_and_outside_rows(spark):
    sch = schedule_df(spark, [(0, 1.0, 1, 10.0), (1, 2.0, 2, 15.0), (2, 4.0, 3, 10.0)])
    runs = runs_df(spark, [("a", 100.0)])
    secs = [-1, 0, 9.999, 10, 19.5, 24.9, 25, 34.999, 35, 100]
    req = request_df(spark, [{"ts": T0 + dt.timedelta(seconds=s), "seq": i}
                             for i, s in enumerate(secs)]).drop("stage_index", "target_rps", "active_users")
    got = {r.seq: r.stage_index for r in assign_stage(req, sch, runs).collect()}
    assert [got[i] for i in range(len(secs))] == [None, 0, 0, 1, 1, 1, 2, 2, None, None]


def test_allocated_rates_per_active_model(spark):
    sch = schedule_df(spark, [(0, 10.0, 1, 60.0)])
    out = sorted((r.model, r.allocated_rps) for r in
                 allocated_rates(sch, runs_df(spark, [("a", 70.0), ("b", 30.0), ("c", 0.0)])).collect())
    assert out == [("a", 7.0), ("b", 3.0)]


def test_stage_lookup_is_a_broadcast_hash_join(spark):
    sch = schedule_df(spark, [(0, 1.0, 1, 10.0)])
    req = request_df(spark, [{}]).drop("stage_index", "target_rps", "active_users")
    plan = assign_stage(req, sch, runs_df(spark, [("a", 100.0)]))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BatchEvalPython" not in plan
    assert F  # imported for callers


def test_requests_at_stage_boundaries(spark):
    """Microseconds decide: a request at a boundary is the next stage's."""
    for step in (10.1, 0.07, 1 / 3):
        sch = schedule_df(spark, [(k, 1.0, 1, step) for k in range(40)]).selectExpr(
            "run_id", "stage_index", "target_rps", "active_users", "duration",
            f"stage_index * {step!r}D AS t0_offset_s", f"(stage_index + 1) * {step!r}D AS t1_offset_s")
        at = [round(k * step * 1e6) for k in range(41)]
        req = request_df(spark, [{"ts": T0 + dt.timedelta(microseconds=us + d), "seq": 3 * i + d + 1}
                                 for i, us in enumerate(at) for d in (-1, 0, 1)]).drop("stage_index", "target_rps", "active_users")
        got = {r.seq: r.stage_index for r in assign_stage(req, sch, runs_df(spark, [("a", 100.0)])).collect()}
        for i in range(41):
            assert [got[3 * i + d] for d in (0, 1, 2)] == [i - 1 if i else None, i if i < 40 else None, i if i < 40 else None]


def test_many_stages_in_one_bucket_and_gaps(spark):
    sch = schedule_df(spark, [(0, 1.0, 1, 100.0), (1, 2.0, 2, 0.01), (2, 3.0, 3, 0.02), (3, 4.0, 4, 0.07), (4, 5.0, 5, 100.0)])
    secs = [0, 99.999999, 100, 100.009999, 100.01, 100.03, 100.099999, 100.1, 200.099999, 200.1]
    req = request_df(spark, [{"ts": T0 + dt.timedelta(seconds=s), "seq": i} for i, s in enumerate(secs)]).drop(
        "stage_index", "target_rps", "active_users")
    got = {r.seq: r.stage_index for r in assign_stage(req, sch, runs_df(spark, [("a", 1.0)])).collect()}
    assert [got[i] for i in range(len(secs))] == [0, 0, 1, 1, 2, 3, 3, 4, 4, None]
    gap = sch.where("stage_index <> 0")
    got = {r.seq: r.stage_index for r in assign_stage(req, gap, runs_df(spark, [("a", 1.0)])).collect()}
    assert [got[i] for i in range(len(secs))] == [None, None, 1, 1, 2, 3, 3, 4, 4, None]


def test_weighted_split_beyond_100_and_fractions(spark):
    req = request_df(spark, [{"seq": s} for s in range(20000)])
    for models, want in (([("a", 100.0), ("b", 100.0)], {"a": 10000, "b": 10000}), ([("a", 0.5), ("b", 99.5)], {"a": 100, "b": 19900}),
                         ([("a", 0.005), ("b", 99.995)], {"a": 1, "b": 19999}), ([("a", 33.25), ("b", 66.75)], {"a": 6650, "b": 13350}), ([("a", 1 / 3), ("b", 1e-12)], {"a": 20000}),
                         ([("a", 30.0), ("b", 20.0)], {"a": 12000, "b": 8000}), ([("a", 0.0)], {None: 20000}), ([], {None: 20000})):
        out = assign_weighted(req, runs_df(spark, models))
        assert {r.assigned_model: r["count"] for r in out.groupBy("assigned_model").count().collect()} == want


def test_users_are_capped_by_credentials(spark):
    from rampstat.operators.assign import cap_users
    sch = schedule_df(spark, [(0, 1.0, 2, 10.0), (1, 2.0, 9, 10.0)])
    tokens = spark.createDataFrame([(0, i) for i in range(3)], "run_id long, token_pos long")
    for public, toks, want in ((False, tokens, [2, 3]), (True, tokens, [2, 9]), (False, tokens.limit(0), [2, 9])):
        runs = spark.createDataFrame([(0, public)], "run_id long, is_public boolean")
        assert [r.active_users for r in cap_users(sch, runs, toks).orderBy("stage_index").collect()] == want


def test_a_share_of_three_in_a_hundred_thousand(spark):
    req = spark.range(200_000).select(F.lit(0).cast("long").alias("run_id"), F.col("id").alias("seq"))
    out = assign_weighted(req, runs_df(spark, [("a", 99.997), ("b", 0.003)]))
    assert {r.assigned_model: r["count"] for r in out.groupBy("assigned_model").count().collect()} == {"a": 199_994, "b": 6}


def test_stages_of_very_unequal_length_and_overlapping_ones(spark):
    """A long stage and thousands of short ones, gaps and overlaps: as looked up one by one."""
    import random
    r = random.Random(3)
    rows, t = [], 0.0
    for i in range(1500):
        length = 5e6 if i == 700 else r.choice([0.000001, 0.5, 2.0, 0.0])
        begin = t + r.choice([0.0, 0.0, 0.25, -0.4])
        rows.append((0, i, float(i), i, length, max(begin, 0.0), max(begin, 0.0) + length))
        t = max(begin, 0.0) + length
    sch = spark.createDataFrame(rows, "run_id bigint, stage_index int, target_rps double, active_users int, duration double, t0_offset_s double, t1_offset_s double")
    runs = spark.createDataFrame([(0, T0)], "run_id bigint, started_at timestamp")
    us = lambda x: round(x * 1e6)
    at = sorted({us(x[5]) + d for x in rows for d in (-1, 0, 1)} | {us(x[6]) + d for x in rows for d in (-1, 0)} | {r.randrange(us(t)) for _ in range(300)})
    req = spark.createDataFrame([(0, x) for x in at], "run_id long, off long").withColumn("ts", F.expr(f"timestamp_micros(unix_micros(TIMESTAMP '{T0}') + off)"))
    got = {q.off: q.stage_index for q in assign_stage(req, sch, runs).collect()}
    slots = sorted((us(x[5]), us(x[6]), x[1]) for x in rows if us(x[6]) > us(x[5]))
    assert got == {x: next((i for a, b, i in slots if a <= x < b), None) for x in at}
