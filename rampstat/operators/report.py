"""Report tables.

Rates are stored in RPS; ``unit`` picks the display unit and the column
suffix (``target_rps`` / ``target_rpm``) when the plan is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampstat.functions.outcome import null_to_empty
from rampstat.functions.rates import column_suffix, report_round, rps_to_display
from rampstat.functions.text import off_scale_note
from rampstat.operators.joins import broadcast_if_small

def raw_report(requests: DataFrame, stages: DataFrame, unit: str = "rps",
               run_col: str = "run_id") -> DataFrame:
    """Every request with its stage's achieved rate (missing -> 0.0),
    rates in ``unit`` rounded to 2, latency rounded to 2, null error -> ''.
    The stage side is one row per (run, stage) - far smaller than the log;
    the planner broadcasts it when its runtime size allows."""
    sfx = column_suffix(unit)
    ach = broadcast_if_small(stages.select(F.col(run_col).alias("_r"), F.col("stage_index").alias("_s"),
                                           F.col("achieved_rps").alias("_ach")))
    cond = (requests[run_col] == ach["_r"]) & (requests["stage_index"] == ach["_s"])
    j = requests.join(ach, cond, "left")
    return j.select(
        requests[run_col], requests["seq"],
        F.col("stage_index").alias("stage"), "model",
        F.col("token_index").alias("token_idx"), "token_label", "active_users",
        report_round(rps_to_display(F.col("target_rps"), unit), 2).alias(f"target_{sfx}"),
        report_round(rps_to_display(F.coalesce(F.col("_ach"), F.lit(0.0)), unit), 2)
        .alias(f"achieved_{sfx}"),
        "status", "status_code",
        report_round(F.col("latency_ms"), 2).alias("latency_ms"),
        null_to_empty("error_type").alias("error_type"),
        "suite_id", "prompt_id")


def head_rows(report: DataFrame, n: int, run_col: str = "run_id") -> DataFrame:
    """The first ``n`` rows in arrival order (a display cap - the limit is
    the feature; Spark plans it as a top-k, no global sort)."""
    return report.orderBy(run_col, "seq").limit(n)


def error_report(requests: DataFrame, include_http_failures: bool = False,
                 run_col: str = "run_id") -> DataFrame:
    """Non-success requests. By default only those with an error type
    (timeouts and exceptions) - HTTP 4xx/5xx carry none and are left out,
    as in the exported sheet; ``include_http_failures`` keeps them."""
    cond = F.col("status") != "success"
    if not include_http_failures:
        cond = cond & F.col("error_type").isNotNull()
    return requests.where(cond).select(run_col, "seq", "stage_index", "model", "status_code",
                                       "error_type", "active_users")


def rate_series(stages: DataFrame, run_col: str = "run_id") -> DataFrame:
    """H1: target and achieved rate per stage in long form, in RPM."""
    return stages.select(
        run_col, "stage_index", "active_users", "total_requests",
        F.expr("stack(2, 'Target RPM', target_rps * 60.0D, 'Achieved RPM', achieved_rps * 60.0D)")
        .alias("series", "rpm"))


def off_scale_marks(scale: DataFrame, run_col: str = "run_id") -> DataFrame:
    """H5: marker (at y_max) and note (at 0.98 * y_max) rows, only for runs
    whose chart is scaled to the achieved rate."""
    s = scale.where(F.col("use_achieved_scale"))
    marker = s.select(run_col, F.lit("marker").alias("kind"),
                      F.col("target_peak_stage").alias("stage_index"),
                      F.col("y_max").alias("rpm"), F.lit(None).cast("string").alias("note"))
    note = s.select(run_col, F.lit("note").alias("kind"),
                    F.col("target_peak_stage").alias("stage_index"),
                    (F.col("y_max") * F.lit(0.98)).alias("rpm"),
                    off_scale_note("target_max").alias("note"))
    return marker.unionByName(note)


def latency_series(stages: DataFrame, run_col: str = "run_id") -> DataFrame:
    """p50/p95/p99 per stage, long form."""
    return stages.select(run_col, "stage_index", F.expr(
        "stack(3, 'P50', p50_latency_ms, 'P95', p95_latency_ms, 'P99', p99_latency_ms)")
        .alias("series", "latency_ms"))


def error_rate_series(stages: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Failed share per stage in percent."""
    return stages.select(run_col, "stage_index", "total_requests",
                         (F.col("error_rate") * F.lit(100.0)).alias("error_rate_pct"))


def stage_pass_flags(stages: DataFrame, threshold: float, run_col: str = "run_id") -> DataFrame:
    """Requests per stage and a pass flag: success share >= threshold."""
    rate = F.when(F.col("total_requests") > 0,
                  F.col("successful") / F.col("total_requests")).otherwise(F.lit(0.0))
    return stages.select(run_col, "stage_index", "total_requests", "successful",
                         rate.alias("success_rate"), (rate >= F.lit(threshold)).alias("passed"))


def model_scatter(models: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per model latency and success rate."""
    return models.select(run_col, "model", "total_requests", "avg_latency_ms", "p95_latency_ms",
                         "success_rate")


# The keys of the configuration table, in its order.
CONFIG_KEYS = ["base_url", "api_path", "rate_unit", "initial_rate_rps", "max_rate_rps",
               "scaling_factor", "time_increment_s", "min_users", "max_users", "users_increment",
               "benchmark_suite", "timeout_s", "model_count", "token_count"]


def _num_text(col):
    """Numbers as text: rounded to 6 decimals, printed with 6 decimals."""
    return F.format_string("%.6f", report_round(F.col(col).cast("double"), 6))


def config_key_values(configs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """H2: 14 key/value rows per run configuration, in a fixed order
    (``ordinal``); values as text, counts E8 via ``size``. Configurations without
    a list of ``tokens`` have their number as ``token_count``."""
    n_tokens = F.col("token_count") if "token_count" in configs.columns else F.size("tokens")
    vals = [F.col("base_url"), F.col("api_path"), F.col("rate_unit"),
            _num_text("initial_rate"), _num_text("max_rate"), _num_text("scaling_factor"),
            _num_text("time_increment"), F.col("min_users").cast("string"),
            F.col("max_users").cast("string"), F.col("users_increment").cast("string"),
            F.col("benchmark_suite"), _num_text("timeout"),
            F.size("models").cast("string"), n_tokens.cast("string")]
    kv = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"))
                   for k, v in zip(CONFIG_KEYS, vals)])
    return configs.select(run_col, F.posexplode(kv).alias("ordinal", "kv")).select(
        run_col, (F.col("ordinal") + 1).cast("int").alias("ordinal"),
        F.col("kv.key").alias("key"), F.col("kv.value").alias("value"))
