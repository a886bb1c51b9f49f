"""Views of the driver's Parquet tables as request-log inputs.

The load tester's own data (request outcomes, run configurations, prompt
catalogue) is derived from the driver tables by fixed rules, identical in
Spark and in the SQL oracle (see FIXTURES.md, part C):

* ``events``   -> raw request outcomes of four runs (``run_id = user_id % 4``);
* ``events``   -> the configuration of those four runs (same ramp for all);
* ``customer`` -> one run configuration per customer, exercising every rule;
* ``benchmark``-> the prompt catalogue (six suites with prompts, one without).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.schema import SUITES

# Ramp used by every event run (fixed parameters of the fixture mapping).
EVENT_RUN_START = "2024-01-01 00:00:00"
EVENT_RUN_INITIAL_RPS = 0.001
EVENT_RUN_MAX_RPS = 0.512
EVENT_RUN_FACTOR = 2.0
EVENT_RUN_STAGE_S = 259200.0
EVENT_RUN_USERS = (1, 5, 1)  # min, max, increment
EVENT_RUN_MODELS = [("model_0", 70.0), ("model_1", 30.0), ("model_2", 0.0)]
N_RUNS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SUITES_SQL = "array(" + ", ".join(f"'{x}'" for x in SUITES) + ")"


def suite_of_sql(index_sql: str) -> str:
    """0-based suite position (SQL) -> suite id (SQL)."""
    return f"element_at({_SUITES_SQL}, CAST(({index_sql}) + 1 AS INT))"


# Expressions are SQL text: each column is parsed once by the JVM instead of
# being assembled call by call from Python.
_RAW_SQL = [
    f"user_id % {N_RUNS} AS run_id",
    "event_id",
    "CAST(ts AS TIMESTAMP) AS ts",
    "concat('model_', CAST(user_id % 3 AS STRING)) AS model",
    "CASE user_id % 3 WHEN 0 THEN 70.0D WHEN 1 THEN 30.0D ELSE 0.0D END AS model_percentage",
    "user_id AS token_index",
    "CASE WHEN user_id % 10 = 0 THEN '' ELSE concat('acct-', CAST(user_id AS STRING)) END AS raw_label",
    f"{suite_of_sql('event_id % 7')} AS suite_id",
    """CAST(CASE WHEN event_type = 'error' AND _k % 3 IN (0, 1) THEN NULL
               WHEN event_type = 'error' AND _k % 3 = 2 AND _k % 2 = 0 THEN 500
               WHEN event_type = 'error' AND _k % 3 = 2 THEN 429
               WHEN event_type = 'signup' AND _k % 10 = 0 THEN 302
               ELSE 200 END AS INT) AS raw_code""",
    """CASE WHEN event_type = 'error' AND _k % 3 = 0 THEN 'timeout'
            WHEN event_type = 'error' AND _k % 3 = 1 THEN 'ConnectError' END AS raw_exception""",
    "value AS raw_latency",
]


def raw_outcomes(events: DataFrame) -> DataFrame:
    """Raw outcomes (input of the normaliser): one row per event."""
    return (events.selectExpr("*", "CAST(get_json_object(props, '$.k') AS BIGINT) AS _k")
            .selectExpr(*_RAW_SQL))


def event_runs(events: DataFrame) -> DataFrame:
    """Configuration of the runs found in ``events`` (one row per run)."""
    return configured_runs(events.selectExpr(f"user_id % {N_RUNS} AS run_id").distinct())


def configured_runs(runs: DataFrame) -> DataFrame:
    """The event runs' configuration for each ``run_id``."""
    mn, mx, inc = EVENT_RUN_USERS
    models = "array(" + ", ".join(
        f"named_struct('model', '{m}', 'percentage', {p!r}D)" for m, p in EVENT_RUN_MODELS) + ")"
    return runs.selectExpr(
        "run_id",
        "'http://inference.local/' AS base_url",
        "'/v1/chat/completions' AS api_path",
        "'rps' AS rate_unit",
        f"{EVENT_RUN_INITIAL_RPS!r}D AS initial_rate",
        f"{EVENT_RUN_MAX_RPS!r}D AS max_rate",
        f"{mn} AS min_users", f"{mx} AS max_users", f"{inc} AS users_increment",
        f"{EVENT_RUN_FACTOR!r}D AS scaling_factor",
        f"{EVENT_RUN_STAGE_S!r}D AS time_increment",
        "false AS is_public",
        f"{models} AS models",
        f"TIMESTAMP '{EVENT_RUN_START}' AS started_at",
    )


def run_users(raw: DataFrame) -> DataFrame:
    """The distinct users of each event run, its credentials."""
    return raw.select("run_id", "token_index", "raw_label").distinct()


def run_tokens(users: DataFrame) -> DataFrame:
    """Credential list of each event run: its users, by user id.
    Returns (run_id, token_pos 0-based, token, label)."""
    from rampstat.operators.ranking import row_number_in_group
    return row_number_in_group(users, ["run_id"], ["token_index"], name="_n").selectExpr(
        "run_id", "_n - 1 AS token_pos", "concat('sk-', CAST(token_index AS STRING)) AS token", "raw_label AS label")


def run_configs(customer: DataFrame) -> DataFrame:
    """One run configuration per customer row (c = c_custkey)."""
    c = "c_custkey"
    return customer.selectExpr(
        f"{c} AS run_id",
        f"concat('http://host-', CAST({c} % 3 AS STRING), '.local', CASE WHEN {c} % 2 = 0 THEN '/' ELSE '' END)"
        " AS base_url",
        f"CASE WHEN {c} % 3 = 0 THEN '/v1/chat/completions/' ELSE 'v1/chat/completions' END AS api_path",
        f"""CASE WHEN {c} % 9 > 0 THEN transform(sequence(1, CAST({c} % 9 AS INT)), i -> named_struct(
                'token', concat('sk-', CAST({c} AS STRING), '-', CAST(i AS STRING)),
                'label', CASE WHEN ({c} + i) % 5 = 0 THEN '' ELSE concat('key-', CAST(i AS STRING)) END))
            ELSE CAST(array() AS array<struct<token:string,label:string>>) END AS tokens""",
        f"""CASE WHEN {c} % 4 > 0 THEN transform(sequence(1, CAST({c} % 4 AS INT)), i -> named_struct(
                'model', CASE WHEN ({c} + i) % 11 = 0 THEN '' ELSE concat('model_', CAST(i AS STRING)) END,
                'percentage', CASE WHEN ({c} + i) % 17 = 0 THEN 150.0D WHEN ({c} + i) % 2 = 0 THEN 100.0D
                                   WHEN ({c} + i) % 3 = 0 THEN 50.0D ELSE 0.0D END))
            ELSE CAST(array() AS array<struct<model:string,percentage:double>>) END AS models""",
        f"CASE WHEN {c} % 2 = 1 THEN 'rpm' ELSE 'rps' END AS rate_unit",
        f"CAST({c} % 20 AS DOUBLE) AS initial_display",
        f"CAST(({c} % 100) - 5 AS DOUBLE) AS max_display",
        f"CASE WHEN {c} % 2 = 1 THEN CAST({c} % 20 AS DOUBLE) / 60.0D ELSE CAST({c} % 20 AS DOUBLE) END"
        " AS initial_rate",
        f"CASE WHEN {c} % 2 = 1 THEN CAST(({c} % 100) - 5 AS DOUBLE) / 60.0D"
        f" ELSE CAST(({c} % 100) - 5 AS DOUBLE) END AS max_rate",
        "CAST(c_nationkey % 6 AS INT) AS min_users",
        f"CAST({c} % 12 AS INT) AS max_users",
        f"CAST({c} % 4 AS INT) AS users_increment",
        f"1.0D + CAST({c} % 5 AS DOUBLE) * 0.5D AS scaling_factor",
        f"CAST(({c} % 7) * 10 AS DOUBLE) AS time_increment",
        f"{suite_of_sql(f'{c} % 7')} AS benchmark_suite",
        "60.0D AS timeout",
        "c_mktsegment = 'BUILDING' AS is_public",
    )


def wide_configs(customer: DataFrame) -> DataFrame:
    """The customers' configurations with other settings: up to 12 models, timeouts from 0 to 699 s and
    up to 12,999 rows shown, so that every range rule (C9) has something to find."""
    c = "c_custkey"
    return run_configs(customer).drop("models", "timeout").join(customer.selectExpr(
        f"{c} AS run_id", f"CAST({c} % 700 AS DOUBLE) AS timeout", f"CAST({c} * 7 % 13000 AS INT) AS num_rows",
        f"""CASE WHEN {c} % 13 > 0 THEN transform(sequence(1, CAST({c} % 13 AS INT)), i -> named_struct(
                'model', concat('model_', CAST(i AS STRING)), 'percentage', 50.0D))
            ELSE CAST(array() AS array<struct<model:string,percentage:double>>) END AS models"""), "run_id")


def segment_suites(customer: DataFrame) -> DataFrame:
    """A suite dimension with suites of the users' own: the fixed ones and one per market segment."""
    spark = customer.sparkSession
    from rampstat.sources.catalogue import suites
    own = customer.selectExpr("concat('segment-', lower(c_mktsegment)) AS suite_id").distinct()
    return suites(spark).select("suite_id").unionByName(own)


def segment_descriptions(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Descriptions of some of those suites (the fixed ones, and segments with an even number of
    letters), and of nations, which are no suites."""
    spark = customer.sparkSession
    from rampstat.sources.catalogue import descriptions
    own = customer.where("length(c_mktsegment) % 2 = 0").selectExpr("concat('segment-', lower(c_mktsegment)) AS suite_id").distinct()
    return descriptions(spark).select("suite_id").unionByName(own).unionByName(nation.selectExpr("concat('nation-', lower(n_name)) AS suite_id"))


def prompts_from_benchmark(benchmark: DataFrame) -> DataFrame:
    """Prompt catalogue rows (suite_id, prompt_index 0-based, text): item i goes
    to suite ``i % 6`` at position ``i div 6``; the seventh suite is empty."""
    return benchmark.selectExpr(f"{suite_of_sql('item_id % 6')} AS suite_id",
                                "item_id div 6 AS prompt_index", "text")


def order_runs(customer: DataFrame) -> DataFrame:
    """The customers' configurations that pass the rate rules (C7, and the smallest
    factor of C9), as runs: ramps, lengths, models, credentials and access all vary."""
    return run_configs(customer).where(
        "initial_rate > 0 AND max_rate >= initial_rate AND scaling_factor >= 1.1D AND time_increment > 0"
    ).withColumn("started_at", F.expr(f"TIMESTAMP '{EVENT_RUN_START}'"))


def order_outcomes(orders: DataFrame, schedule: DataFrame) -> DataFrame:
    """Raw outcomes of those runs: one per order of the customer. Requests come at 96ths of
    the run's length, some exactly at a stage's first microsecond, some beyond the end."""
    from rampstat.operators.joins import broadcast_if_small
    spans = broadcast_if_small(schedule.groupBy("run_id").agg(
        F.expr("sum(CAST(round(duration * 1e6D) AS BIGINT))").alias("_span")))
    k = "o_orderkey"
    return orders.join(spans, orders.o_custkey == spans.run_id).selectExpr(
        "run_id", f"{k} AS event_id",
        f"timestamp_micros(unix_micros(TIMESTAMP '{EVENT_RUN_START}') + ({k} % 101) * _span div 96) AS ts",
        "'model_1' AS model", "0D AS model_percentage", f"{k} % 3 AS token_index", "'' AS raw_label",
        f"{suite_of_sql(f'{k} % 7')} AS suite_id",
        f"CASE {k} % 7 WHEN 0 THEN 500 WHEN 1 THEN NULL ELSE 200 END AS raw_code",
        f"CASE WHEN {k} % 14 = 1 THEN 'ConnectError' WHEN {k} % 7 = 1 THEN 'timeout' END AS raw_exception",
        "o_totalprice AS raw_latency")


def order_run_ends(runs: DataFrame) -> DataFrame:
    """How some of those runs ended: cancelled, or reported complete."""
    return runs.where("run_id % 13 < 2").selectExpr(
        "run_id", "IF(run_id % 13 = 0, 'error', 'completed') AS end_status", "IF(run_id % 13 = 0, 'Test cancelled', NULL) AS end_message")
