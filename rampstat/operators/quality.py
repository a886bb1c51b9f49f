"""Data-quality rules over run configurations.

``audit_run_config`` turns every configuration row into its list of rule
messages, in the order the configuration screen reports them: credential
rules (only when credentials exist), model rules, rate rules, user rules.
Each rule is a column expression; the messages of a row are gathered into
one array and exploded, so the audit is a single narrow pass over any
number of configurations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampstat.schema import (
    FACTOR_RANGE, MAX_MODELS, MAX_USERS_CAP, RATE_RANGE, ROWS_RANGE, STAGE_SECONDS_RANGE, TIMEOUT_RANGE,
)

_MSG = "struct<rule:string,message:string>"


def _msg(cond: Column, rule: str, message: Column) -> Column:
    return F.when(cond, F.struct(F.lit(rule).alias("rule"), message.alias("message")))


def _compact(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def token_rules(min_users="min_users", max_users="max_users", tokens="tokens") -> Column:
    """C5 (applied only when at least one credential is configured)."""
    n = F.size(tokens)
    has = n > 0
    mn, mx = F.col(min_users), F.col(max_users)
    return _compact(
        _msg(has & (mn > n), "token_count",
             F.concat(F.lit("min_users ("), mn.cast("string"), F.lit(") exceeds token count ("),
                      n.cast("string"), F.lit("). Truncate to token count."))),
        _msg(has & (F.least(mx, n) < 1), "no_usable_tokens",
             F.concat(F.lit("No usable tokens (token_count="), n.cast("string"), F.lit(")"))),
    )


def model_rules(models="models") -> Column:
    """No model; per entry blank name (skips its range check) or
    percentage outside 0-100; two or more entries at exactly 100 %."""
    ms = F.col(models)
    per_entry = F.filter(F.transform(ms, lambda m: F.when(
        m["model"].isNull() | m["model"].rlike(r"^\s*$"),
        F.struct(F.lit("blank_model_name").alias("rule"),
                 F.lit("All models must have a non-empty name.").alias("message"))
    ).when(
        (m["percentage"] < 0) | (m["percentage"] > 100),
        F.struct(F.lit("model_percentage").alias("rule"),
                 F.concat(F.lit("Model '"), m["model"], F.lit("': percentage must be 0-100."))
                 .alias("message")))), lambda x: x.isNotNull())
    full = F.array_sort(F.transform(F.filter(ms, lambda m: m["percentage"] == 100),
                                    lambda m: m["model"]))
    multi = _compact(_msg(F.size(full) >= 2, "multiple_full_models",
                          F.concat(F.lit("Multiple models at 100% detected ("),
                                   F.array_join(full, ", "),
                                   F.lit("). Each will receive 100% of load (duplicated traffic)."))))
    none = F.array(F.struct(F.lit("no_models").alias("rule"),
                            F.lit("At least one model must be configured.").alias("message")))
    return F.when(F.size(ms) == 0, none).otherwise(F.concat(per_entry, multi))


def rate_rules(initial="initial_rate", max_rate="max_rate", factor="scaling_factor",
               increment="time_increment", unit="rate_unit") -> Column:
    """Rates are canonical RPS; the unit only labels the message."""
    label = F.upper(F.col(unit))
    i, m = F.col(initial), F.col(max_rate)
    return _compact(
        _msg(i <= 0, "initial_rate", F.concat(F.lit("Initial "), label, F.lit(" must be > 0"))),
        _msg(m < i, "max_rate", F.concat(F.lit("Max "), label, F.lit(" must be >= Initial "), label)),
        _msg(F.col(factor) <= 1.0, "scaling_factor", F.lit("Scaling factor must be > 1.0")),
        _msg(F.col(increment) <= 0, "time_increment", F.lit("Time increment must be > 0")),
    )


def user_rules(min_users="min_users", max_users="max_users", increment="users_increment") -> Column:
    """C8."""
    mn, mx = F.col(min_users), F.col(max_users)
    return _compact(
        _msg(mn < 1, "min_users", F.lit("min_users must be >= 1")),
        _msg(mx < mn, "max_users", F.lit("max_users must be >= min_users")),
        _msg(F.col(increment) < 1, "users_increment", F.lit("users_increment must be >= 1")),
    )


def audit_run_config(configs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """C5-C8 + H3: (run_id, msg_index, rule, message), one row per message."""
    allm = F.concat(token_rules(), model_rules(), rate_rules(), user_rules())
    return configs.select(run_col, F.posexplode(allm).alias("msg_index", "m")).select(
        run_col, F.col("msg_index").cast("int").alias("msg_index"),
        F.col("m.rule").alias("rule"), F.col("m.message").alias("message"))


def range_checks(columns: list[str]) -> Column:
    """The settings outside the ranges the configuration form allows, as an array of (rule,
    value). Expects ``initial_display, max_display`` (slider values); ``num_rows`` (rows
    shown of the raw table) is checked where ``columns`` has it."""
    lo_r, hi_r = RATE_RANGE
    lo_f, hi_f = FACTOR_RANGE
    lo_s, hi_s = STAGE_SECONDS_RANGE
    lo_t, hi_t = TIMEOUT_RANGE
    n_tok = F.size("tokens")
    cap = F.least(n_tok, F.lit(MAX_USERS_CAP))

    def out(cond, rule, value):
        return F.when(cond, F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value")))
    return F.filter(F.array(
        out(~F.col("initial_display").between(lo_r, hi_r), "initial_rate_range", F.col("initial_display")),
        out(~F.col("max_display").between(lo_r, hi_r), "max_rate_range", F.col("max_display")),
        out(F.col("max_display") < F.col("initial_display"), "max_below_initial", F.col("max_display")),
        out(~F.col("scaling_factor").between(lo_f, hi_f), "scaling_factor_range", F.col("scaling_factor")),
        out(~F.col("time_increment").between(lo_s, hi_s), "time_increment_range", F.col("time_increment")),
        out(F.size("models") > MAX_MODELS, "model_count_range", F.size("models")),
        out(F.exists("models", lambda m: (m["percentage"] < 0) | (m["percentage"] > 100)),
            "percentage_range", F.size(F.filter("models", lambda m: (m["percentage"] < 0)
                                                 | (m["percentage"] > 100)))),
        out(~F.col("timeout").between(lo_t, hi_t), "timeout_range", F.col("timeout")),
        out((n_tok > 0) & (F.col("max_users") > cap), "users_over_token_cap", F.col("max_users")),
        *([out(~F.col("num_rows").between(*ROWS_RANGE), "rows_range", F.col("num_rows"))] if "num_rows" in columns else []),
    ), lambda x: x.isNotNull())


def audit_ranges(configs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """(run_id, rule, value), one row per setting outside its range."""
    return configs.select(run_col, F.explode(range_checks(configs.columns)).alias("c")).select(
        run_col, F.col("c.rule").alias("rule"), F.col("c.value").alias("value"))


def configs_without_credentials(configs: DataFrame, credentials: DataFrame,
                                run_col: str = "run_id") -> DataFrame:
    """Runs that are not public and have no credential - such a run ends
    as an error without requests. ``credentials`` has one row per
    (run, credential); the anti join keeps runs with none."""
    private = configs.where(~F.col("is_public")).select(run_col)
    return private.join(credentials.select(run_col).distinct(), run_col, "left_anti")


def run_status(schedule: DataFrame, requests: DataFrame, blocked: DataFrame,
               run_col: str = "run_id", ends: DataFrame | None = None) -> DataFrame:
    """C11: ``error`` for runs blocked by C10. ``ends`` tells how runs ended
    (run, ``end_status``: completed, running or error, ``end_message``) and decides
    where it has a row; without one, a run is ``completed`` when its last planned
    stage has requests and ``running`` otherwise (stopped early, partial rows kept)."""
    planned = schedule.groupBy(run_col).agg(F.count("*").cast("long").alias("planned_stages"),
                                            F.max("stage_index").alias("_last"))
    seen = requests.where(F.col("stage_index").isNotNull()).groupBy(run_col).agg(
        F.countDistinct("stage_index").cast("long").alias("observed_stages"),
        F.max("stage_index").alias("_seen_last"))
    b = blocked.select(run_col, F.lit(True).alias("_blocked"))
    j = planned.join(seen, run_col, "left").join(b, run_col, "left")
    if ends is None:
        j = j.withColumns({"end_status": F.lit(None).cast("string"), "end_message": F.lit(None).cast("string")})
    else:
        j = j.join(ends.select(run_col, "end_status", "end_message"), run_col, "left")
    status = (F.when(F.col("_blocked"), F.lit("error"))
              .when(F.col("end_status").isNotNull(), F.col("end_status"))
              .when(F.col("_seen_last") == F.col("_last"), F.lit("completed"))
              .otherwise(F.lit("running")))
    msg = F.when(F.col("_blocked"), F.lit("no credential configured for a private endpoint")) \
        .when(F.col("end_status") == "error", F.coalesce("end_message", F.lit(""))).otherwise(F.lit(""))
    return j.select(run_col, "planned_stages",
                    F.coalesce(F.col("observed_stages"), F.lit(0)).cast("long").alias("observed_stages"),
                    status.alias("run_status"), msg.alias("error_message"))
