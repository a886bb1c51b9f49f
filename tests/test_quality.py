"""Configuration rules - the load tester's validation cases, plus the
fixture counts of FIXTURES.md at sf0.01."""

import pytest
from pyspark.sql import functions as F

from rampstat.operators.quality import audit_ranges, audit_run_config, configs_without_credentials
from rampstat.sources import fixtures as fx
from tests.conftest import SF01

SCHEMA = ("run_id bigint, tokens array<struct<token:string,label:string>>, "
          "models array<struct<model:string,percentage:double>>, rate_unit string, initial_rate double, "
          "max_rate double, min_users int, max_users int, users_increment int, scaling_factor double, "
          "time_increment double, is_public boolean")
OK = dict(tokens=[("t", "a")] * 5, models=[("m", 100.0)], rate_unit="rps", initial_rate=1.0,
          max_rate=10.0, min_users=1, max_users=3, users_increment=1, scaling_factor=2.0,
          time_increment=10.0, is_public=False)
COLS = ["tokens", "models", "rate_unit", "initial_rate", "max_rate", "min_users", "max_users",
        "users_increment", "scaling_factor", "time_increment", "is_public"]


def audit(spark, **over):
    d = dict(OK)
    d.update(over)
    df = spark.createDataFrame([(0, *[d[c] for c in COLS])], SCHEMA)
    return [(r.rule, r.message) for r in audit_run_config(df).orderBy("msg_index").collect()]


def test_valid_config_has_no_messages(spark):
    assert audit(spark) == []


def test_token_rules(spark):
    msgs = audit(spark, tokens=[("t", "a")] * 2, min_users=5, max_users=6)
    assert msgs == [("token_count", "min_users (5) exceeds token count (2). Truncate to token count.")]
    # no credentials: the token rules are not applied
    assert audit(spark, tokens=[], min_users=5, max_users=6) == []


def test_model_rules(spark):
    assert audit(spark, models=[]) == [("no_models", "At least one model must be configured.")]
    msgs = audit(spark, models=[("b", 100.0), ("a", 100.0)])
    assert len(msgs) == 1 and "100%" in msgs[0][1] and "(a, b)" in msgs[0][1]
    msgs = audit(spark, models=[(" ", 150.0), ("x", 150.0)])
    assert msgs == [("blank_model_name", "All models must have a non-empty name."),
                    ("model_percentage", "Model 'x': percentage must be 0-100.")]


def test_rate_rules(spark):
    assert [m for _, m in audit(spark, initial_rate=0.0)] == ["Initial RPS must be > 0"]
    assert [m for _, m in audit(spark, time_increment=0.0)] == ["Time increment must be > 0"]
    assert [m for _, m in audit(spark, rate_unit="rpm", max_rate=0.5)] == ["Max RPM must be >= Initial RPM"]
    assert [m for _, m in audit(spark, scaling_factor=1.0)] == ["Scaling factor must be > 1.0"]


def test_user_rules(spark):
    assert [r for r, _ in audit(spark, min_users=5, max_users=3)] == ["max_users"]
    assert [r for r, _ in audit(spark, users_increment=0)] == ["users_increment"]
    assert [r for r, _ in audit(spark, tokens=[], min_users=0)] == ["min_users"]


def test_message_order_follows_the_screen(spark):
    msgs = audit(spark, tokens=[("t", "")], min_users=0, max_users=0, models=[],
                 initial_rate=0.0, users_increment=0)
    assert [r for r, _ in msgs] == ["no_usable_tokens", "no_models", "initial_rate", "min_users",
                                    "users_increment"]


@pytest.fixture(scope="module")
def configs(spark):
    return fx.run_configs(fx.table(spark, SF01, "customer")).cache()


def test_fixture_condition_counts(spark, configs):
    """Raw violating conditions of the fixture mapping (FIXTURES.md, part C)."""
    n_tok = F.size("tokens")
    c = configs.agg(
        F.count_if(F.col("min_users") > n_tok).alias("min_gt_tokens"),
        F.count_if(F.least(F.col("max_users"), n_tok) < 1).alias("no_usable"),
        F.sum(F.size(F.filter("models", lambda m: m["percentage"] > 100))).alias("pct_over")).first()
    assert (c.min_gt_tokens, c.no_usable, c.pct_over) == (392, 250, 132)


def test_fixture_rule_counts(spark, configs):
    """Messages: credential rules only apply when credentials exist, and a
    blank-named model skips its range check - so three counts are lower than
    the raw conditions above."""
    got = {r.rule: r["count"] for r in audit_run_config(configs).groupBy("rule").count().collect()}
    expect = {"token_count": 266, "no_usable_tokens": 83, "initial_rate": 75, "max_rate": 300,
              "scaling_factor": 300, "time_increment": 215, "min_users": 298, "max_users": 289,
              "users_increment": 375, "model_percentage": 120, "blank_model_name": 204,
              "multiple_full_models": 331, "no_models": 375}
    assert got == expect


def test_fixture_configs_without_credentials(spark, configs):
    creds = configs.select("run_id", F.explode("tokens").alias("t"))
    assert configs_without_credentials(configs, creds).count() == 135


def test_range_rules(spark, configs):
    rules = {r.rule for r in audit_ranges(configs).select("rule").distinct().collect()}
    assert {"initial_rate_range", "scaling_factor_range", "time_increment_range",
            "percentage_range"} <= rules


def test_names_of_any_white_space_are_blank_and_rows_are_checked(spark):
    from rampstat.operators.quality import audit_ranges, model_rules
    df = spark.sql("SELECT array(named_struct('model', '\\t\\n', 'percentage', 5D)) AS models")
    assert [m.rule for m in df.select(model_rules().alias("m")).first().m] == ["blank_model_name"]
    cfg = ("SELECT {0} AS run_id, 5D AS initial_display, 9D AS max_display, 2D AS scaling_factor, 60D AS time_increment, "
           "array(named_struct('model', 'a', 'percentage', 5D)) AS models, 60D AS timeout, array('t') AS tokens, 1 AS max_users, {1} AS num_rows")
    rows = spark.sql(" UNION ALL ".join(cfg.format(i, n) for i, n in enumerate((9, 10, 10000, 10001))))
    assert sorted((r.run_id, r.rule, r.value) for r in audit_ranges(rows).collect()) == [(0, "rows_range", "9"), (3, "rows_range", "10001")]


def test_how_a_run_ended_decides(spark):
    from rampstat.operators.quality import run_status
    sch = spark.createDataFrame([(r, s) for r in range(5) for s in range(2)], "run_id long, stage_index int")
    req = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 1)], "run_id long, stage_index int")
    ends = spark.createDataFrame([(1, "completed", None), (3, "error", "Test cancelled"), (4, "completed", None)],
                                 "run_id long, end_status string, end_message string")
    blocked = spark.createDataFrame([(4,)], "run_id long")
    got = {r.run_id: (r.run_status, r.error_message) for r in run_status(sch, req, blocked, ends=ends).collect()}
    assert got == {0: ("completed", ""), 1: ("completed", ""), 2: ("running", ""), 3: ("error", "Test cancelled"),
                   4: ("error", "no credential configured for a private endpoint")}
