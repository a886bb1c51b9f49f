"""Driver queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables of ``sf_dir`` in full and returns a
DataFrame (the caller collects). Reports of the event runs read one stored log
(``pipeline.event_runs``), which the first of them builds; small side tables are computed
when the DataFrame is built. Timestamps leave as TIMESTAMP_NTZ, like the
source Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rampstat.functions.rates import (
    display_to_rps, format_rate_conversion, format_rate_value, report_round, rps_to_display, rps_to_display_int,
)
from rampstat.functions.text import endpoint_url, endpoint_url_view, request_payload
from rampstat.operators import aggregate as agg
from rampstat.operators import assign as asg
from rampstat.operators import profiles as prof
from rampstat.operators import progress as prog
from rampstat.operators import quality as dq
from rampstat.operators import report as rep
from rampstat.operators.percentiles import PCTS, approx_rank_error, floor_rank_percentiles
from rampstat.operators.schedule import build_schedule, schedule_offsets, stage_counts
from rampstat.plans.bundle import bundle_part
from rampstat.plans.pipeline import EventRuns, OrderRuns, event_runs, with_ntz
from rampstat.session import prepare, scratch_path
from rampstat.sources import catalogue as cat
from rampstat.sources import credentials as cred
from rampstat.sources import fixtures as fx
from rampstat.sources.request_log import read_request_log, stage_report, write_request_log

PASS_THRESHOLD = 0.8
HEAD_ROWS = 100
AS_OF = "2024-02-01 00:00:00"
PCT_COLS = agg.PCT_COLS


def _runs(spark, sf_dir) -> EventRuns:
    return event_runs(spark, sf_dir)


def q_normalized_requests(spark, sf_dir):
    return with_ntz(_runs(spark, sf_dir).requests())


def _stage_metrics(er: EventRuns, method="histogram") -> DataFrame:
    return agg.stage_metrics(er.requests(with_seq=False), er.schedule, method=method)


def q_stage_metrics(spark, sf_dir):
    return _stage_metrics(_runs(spark, sf_dir))


def q_stage_metrics_observed(spark, sf_dir):
    """E1 with E5's observed elapsed time (first to last request of a stage)."""
    er = _runs(spark, sf_dir)
    req = er.requests(with_seq=False)
    return agg.stage_metrics(req, er.schedule, elapsed=agg.observed_elapsed(req))


def q_stage_metrics_rpm(spark, sf_dir):
    sm = _stage_metrics(_runs(spark, sf_dir))
    return sm.select(
        "run_id", "stage_index", "elapsed_seconds",
        report_round(rps_to_display(F.col("target_rps"), "rpm"), 4).alias("target_rpm"),
        report_round(rps_to_display(F.col("achieved_rps"), "rpm"), 4).alias("achieved_rpm"),
        format_rate_value(F.col("target_rps"), "rpm").alias("target_label"),
        "active_users", "total_requests", "successful", "failed", "avg_latency_ms", *PCT_COLS,
        "error_rate")


def _pct_query(spark, sf_dir, method):
    er = _runs(spark, sf_dir)
    req = er.requests(with_seq=False).where(F.col("stage_index").isNotNull())
    p = floor_rank_percentiles(req, ["run_id", "stage_index"], "latency_ms", PCTS, method, PCT_COLS)
    n = req.groupBy("run_id", "stage_index").agg(F.count("*").cast("long").alias("n"))
    return n.join(p, ["run_id", "stage_index"])


def q_percentiles_histogram(spark, sf_dir):
    return _pct_query(spark, sf_dir, "histogram")


def q_percentiles_disc(spark, sf_dir):
    return _pct_query(spark, sf_dir, "disc")


def q_approx_percentiles(spark, sf_dir):
    """The approximate form's rank error, held against the bound it promises."""
    req = _runs(spark, sf_dir).requests(with_seq=False).where(F.col("stage_index").isNotNull())
    return approx_rank_error(req, ["run_id", "stage_index"], "latency_ms", PCTS)


def q_sketched_percentiles(spark, sf_dir):
    """E2 by KLL: sketches per (run, stage, model) merged into those of runs; the rank error
    held against the sketch's bound, by exact ranks."""
    req = _runs(spark, sf_dir).requests(with_seq=False)
    fine = prof.latency_sketches(req, ["run_id", "stage_index", "model"])
    return prof.sketch_rank_error(req, prof.merged_sketches(fine, ["run_id"]), ["run_id"])


def q_incremental_rollup(spark, sf_dir):
    """E1/E3/E4/E16 kept up to date: the log is added to a stored histogram as it comes, in three
    stretches of time; the profiles of all grains come from what is stored."""
    req = _runs(spark, sf_dir).requests(with_seq=False)
    store = prof.ProfileStore(spark, scratch_path(spark, "profiles"))
    for k, stretch in enumerate(["ts < TIMESTAMP '2024-01-11'", "ts >= TIMESTAMP '2024-01-11' AND ts < TIMESTAMP '2024-01-21'", "ts >= TIMESTAMP '2024-01-21'"]):
        store.add(req.where(stretch), k)
    return store.rollup()


def q_model_summary(spark, sf_dir):
    return agg.model_summary(_runs(spark, sf_dir).requests(), use_seq=True)


def q_run_summary(spark, sf_dir):
    return agg.run_summary(_runs(spark, sf_dir).requests(with_seq=False))


def q_stored_run_summary(spark, sf_dir):
    """A1: the normalised log is written by run and the summary reads it back."""
    path = scratch_path(spark, "request-log")
    write_request_log(_runs(spark, sf_dir).requests(), path)
    return agg.run_summary(read_request_log(spark, path))


def q_multi_grain_rollup(spark, sf_dir):
    return agg.multi_grain_rollup(_runs(spark, sf_dir).requests(with_seq=False))


def _raw_report(spark, sf_dir):
    er = _runs(spark, sf_dir)
    return rep.raw_report(er.requests(), _stage_metrics(er), unit="rps")


def q_raw_report(spark, sf_dir):
    return _raw_report(spark, sf_dir)


def q_raw_report_head(spark, sf_dir):
    """The first rows in arrival order - a top-k of the log; only those are numbered."""
    er = _runs(spark, sf_dir)
    head = er.requests(with_seq=False).orderBy("run_id", "ts", "event_id").limit(HEAD_ROWS)
    numbered = head.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")).cast("long"))
    return rep.head_rows(rep.raw_report(numbered, _stage_metrics(er), unit="rps"), HEAD_ROWS)


def q_error_report(spark, sf_dir):
    return rep.error_report(_runs(spark, sf_dir).requests())


def q_error_report_all(spark, sf_dir):
    return rep.error_report(_runs(spark, sf_dir).requests(), include_http_failures=True)


def q_rate_series(spark, sf_dir):
    return rep.rate_series(_stage_metrics(_runs(spark, sf_dir)))


def q_scale_decision(spark, sf_dir):
    return agg.scale_info(_stage_metrics(_runs(spark, sf_dir)))


def q_off_scale_notes(spark, sf_dir):
    return rep.off_scale_marks(agg.scale_info(_stage_metrics(_runs(spark, sf_dir))))


def q_latency_series(spark, sf_dir):
    return rep.latency_series(_stage_metrics(_runs(spark, sf_dir)))


def q_error_rate_series(spark, sf_dir):
    return rep.error_rate_series(_stage_metrics(_runs(spark, sf_dir)))


def q_stage_pass_flags(spark, sf_dir):
    return rep.stage_pass_flags(_stage_metrics(_runs(spark, sf_dir)), PASS_THRESHOLD)


def q_model_scatter(spark, sf_dir):
    return rep.model_scatter(agg.model_summary(_runs(spark, sf_dir).requests(), use_seq=True))


def _configs(spark, sf_dir) -> DataFrame:
    prepare(spark)
    return fx.run_configs(fx.table(spark, sf_dir, "customer"))


def q_ramp_schedule(spark, sf_dir):
    return build_schedule(_configs(spark, sf_dir)).select(
        "run_id", "stage_index", "target_rps", "active_users", "duration")


def q_schedule_offsets(spark, sf_dir):
    sch = build_schedule(_configs(spark, sf_dir))
    off = schedule_offsets(sch)
    return off.join(stage_counts(sch), "run_id").select(
        "run_id", "stage_index", "t0_offset_s", "t1_offset_s", "total_stages")


def _assign(fn):
    def q(spark, sf_dir):
        er = _runs(spark, sf_dir)
        out = fn(er.requests(), er.runs)
        return out.select("run_id", "seq", "model", "assigned_model", "assigned_percentage")
    return q


q_assign_round_robin = _assign(asg.assign_round_robin)
q_assign_weighted = _assign(asg.assign_weighted)
q_assign_duplicate = _assign(asg.assign_duplicate)


def q_assign_credential(spark, sf_dir):
    er = _runs(spark, sf_dir)
    return asg.assign_credential(er.requests(), er.tokens()).select(
        "run_id", "seq", "token_idx", "assigned_label", "token_sha256")


def q_assign_prompt(spark, sf_dir):
    er = _runs(spark, sf_dir)
    return asg.assign_prompt(er.requests(), er.prompts()).select(
        "run_id", "seq", "suite_id", "prompt_index", "assigned_prompt_id", "prompt_text")


def q_allocated_rates(spark, sf_dir):
    er = _runs(spark, sf_dir)
    return asg.allocated_rates(er.schedule, er.runs)


def q_progress_running(spark, sf_dir):
    er = _runs(spark, sf_dir)
    return prog.running_progress(er.requests(with_seq=False), er.schedule, er.runs)


def q_pacing_gaps(spark, sf_dir):
    return prog.pacing_gaps(_runs(spark, sf_dir).requests())


def q_latest_snapshot(spark, sf_dir):
    return with_ntz(prog.latest_snapshot(_runs(spark, sf_dir).requests(with_seq=False), AS_OF),
                    ("last_ts",))


def q_config_audit(spark, sf_dir):
    return dq.audit_run_config(_configs(spark, sf_dir))


def q_config_range_audit(spark, sf_dir):
    return dq.audit_ranges(_configs(spark, sf_dir))


def q_config_key_values(spark, sf_dir):
    return rep.config_key_values(_configs(spark, sf_dir))


def _config_credentials(configs: DataFrame) -> DataFrame:
    return configs.select("run_id", F.explode("tokens").alias("t")).select("run_id", "t.token", "t.label")


def q_configs_without_credentials(spark, sf_dir):
    cfg = _configs(spark, sf_dir)
    return dq.configs_without_credentials(cfg, _config_credentials(cfg))


def q_config_overview(spark, sf_dir):
    """B10 endpoint, B17 effective first-stage users, E8 counts, E9 full
    models, D7 suite description - one row per configuration."""
    cfg = _configs(spark, sf_dir)
    n_tok = F.size("tokens")
    eff_users = F.when(~F.col("is_public") & (n_tok > 0), F.least(F.col("min_users"), n_tok)) \
        .otherwise(F.col("min_users"))
    full = F.array_join(F.array_sort(F.transform(F.filter("models", lambda m: m["percentage"] == 100),
                                                 lambda m: m["model"])), ", ")
    base = cfg.select("run_id", "benchmark_suite",
                      endpoint_url("base_url", "api_path").alias("endpoint"),
                      eff_users.cast("int").alias("effective_users"),
                      F.size("models").cast("int").alias("model_count"),
                      n_tok.cast("int").alias("token_count"), full.alias("full_models"))
    return cat.suite_lookup(base, cat.descriptions(spark), "benchmark_suite")


def q_rate_texts(spark, sf_dir):
    """B3, B4, B6 and B10's view form of every configuration."""
    c = _configs(spark, sf_dir)
    rps = display_to_rps("initial_display", "rate_unit")
    return c.select("run_id", rps.alias("initial_rps"), rps_to_display_int(rps, "rate_unit").alias("initial_shown"),
                    format_rate_conversion("initial_display", "rate_unit").alias("conversion"),
                    endpoint_url_view("base_url", "api_path").alias("endpoint_view"))


def q_run_status(spark, sf_dir):
    er = _runs(spark, sf_dir)
    tokens = er.tokens()
    blocked = dq.configs_without_credentials(er.runs, tokens)
    return dq.run_status(er.schedule, er.requests(with_seq=False), blocked)


def q_prompt_catalogue(spark, sf_dir):
    er = _runs(spark, sf_dir)
    return cat.prompt_catalogue(er.prompts(), cat.suites(spark))


def q_suite_coverage(spark, sf_dir):
    er = _runs(spark, sf_dir)
    return cat.suite_coverage(cat.suites(spark), cat.descriptions(spark), er.prompts())


def q_suite_coverage_segments(spark, sf_dir):
    """D8 with suites of the users' own: all three findings."""
    prepare(spark)
    customer = fx.table(spark, sf_dir, "customer")
    return cat.suite_coverage(fx.segment_suites(customer), fx.segment_descriptions(customer, fx.table(spark, sf_dir, "nation")),
                              _runs(spark, sf_dir).prompts())


def q_suite_prompts(spark, sf_dir):
    """Each suite's prompts as one list, the lists flattened again, and one suite looked up."""
    prompts = _runs(spark, sf_dir).prompts()
    lists = prompts.groupBy("suite_id").agg(F.map_from_entries(F.collect_list(F.struct("prompt_index", "text"))).alias("by_index"))
    flat = cat.flattened(lists.select("suite_id", F.transform(F.array_sort(F.map_keys("by_index")), lambda i: F.col("by_index")[i]).alias("texts")))
    return cat.get_suite(flat, "coding").select("suite_id", "prompt_index", "text")


def q_config_range_audit_wide(spark, sf_dir):
    """C9 over configurations that break every range."""
    prepare(spark)
    return dq.audit_ranges(fx.wide_configs(fx.table(spark, sf_dir, "customer")))


def q_live_progress(spark, sf_dir):
    """The dashboard's live query over the events, stopped after its first files and
    resumed from its checkpoint when more have come."""
    from rampstat.streaming.live import live_progress_table
    return with_ntz(live_progress_table(spark, sf_dir), ("last_ts",))


def q_suite_counts(spark, sf_dir):
    er = _runs(spark, sf_dir)
    return cat.suite_counts(cat.suites(spark), er.prompts())


def q_request_payloads(spark, sf_dir):
    er = _runs(spark, sf_dir)
    p = asg.assign_prompt(er.requests(), er.prompts())
    body = p.select("run_id", "seq", request_payload("model", "prompt_text").alias("payload"))
    parsed = F.from_json("payload", "model string, messages array<struct<role:string,content:string>>, "
                                    "stream boolean, temperature double")
    return body.select("run_id", "seq", parsed.alias("j")).select(
        "run_id", "seq", F.col("j.model").alias("model"),
        F.col("j.messages")[0]["role"].alias("role"),
        F.length(F.col("j.messages")[0]["content"]).cast("long").alias("content_chars"),
        F.size("j.messages").cast("int").alias("n_messages"),
        F.col("j.stream").alias("stream"), F.col("j.temperature").alias("temperature"))


def _credential_parse(spark, sf_dir):
    prepare(spark)
    lines = cred.credential_lines_from_customers(fx.table(spark, sf_dir, "customer"))
    return cred.parse_credential_lines(lines)


def q_credential_tokens(spark, sf_dir):
    return _credential_parse(spark, sf_dir)[0]


def q_credential_rejects(spark, sf_dir):
    return _credential_parse(spark, sf_dir)[1]


def q_stream_progress(spark, sf_dir):
    from rampstat.streaming.live import stream_progress_table
    return stream_progress_table(spark, sf_dir)


def q_stream_latest_snapshot(spark, sf_dir):
    from rampstat.streaming.live import stream_latest_table
    return with_ntz(stream_latest_table(spark, sf_dir), ("last_ts",))


def q_config_json(spark, sf_dir):
    """Configuration summary JSON per run (with the suite description)."""
    from rampstat.functions.config_json import config_json
    cfg = cat.suite_lookup(_configs(spark, sf_dir), cat.descriptions(spark), "benchmark_suite")
    return cfg.select("run_id", config_json(F.col("suite_label")).alias("config_json"))


def q_stage_report(spark, sf_dir):
    """The stage sheet in the run's unit (RPS here)."""
    return stage_report(_stage_metrics(_runs(spark, sf_dir)), "rps")


def _bundle(part):
    def q(spark, sf_dir):
        return bundle_part(_runs(spark, sf_dir), part)
    return q


def q_credential_file_tokens(spark, sf_dir):
    """A3 over real files: the customers' credential files are written as text and read back."""
    prepare(spark)
    lines = cred.credential_lines_from_customers(fx.table(spark, sf_dir, "customer"))
    path = scratch_path(spark, "credentials")
    cred.write_credential_runs(lines, path)  # a nation's customers: a file of many runs
    return cred.parse_credential_lines(cred.read_credential_runs(spark, path))[0]


def q_order_requests(spark, sf_dir):
    """D3 at boundaries and outside every slot, B17, F5 over runs of many kinds."""
    return OrderRuns(spark, sf_dir).requests().select(
        "run_id", "seq", "event_id", "stage_index", "target_rps", "active_users", "status", "latency_ms")


def _order_stages(spark, sf_dir):
    o = OrderRuns(spark, sf_dir)
    return agg.stage_metrics(o.staged, o.schedule)


def q_order_stage_metrics(spark, sf_dir):
    return _order_stages(spark, sf_dir)


def q_order_scale_decision(spark, sf_dir):
    return agg.scale_info(_order_stages(spark, sf_dir))


def _order_assign(fn):
    def q(spark, sf_dir):
        o = OrderRuns(spark, sf_dir)
        return fn(o.requests(), o.runs).select("run_id", "seq", "assigned_model", "assigned_percentage")
    return q


q_order_round_robin = _order_assign(asg.assign_round_robin)
q_order_weighted = _order_assign(asg.assign_weighted)
q_order_duplicate = _order_assign(asg.assign_duplicate)


def q_order_credentials(spark, sf_dir):
    o = OrderRuns(spark, sf_dir)
    return asg.assign_credential(o.requests(), o.tokens).select("run_id", "seq", "token_idx", "assigned_label")


def q_order_run_status(spark, sf_dir):
    o = OrderRuns(spark, sf_dir)
    return dq.run_status(o.schedule, o.staged, dq.configs_without_credentials(o.runs, o.tokens), ends=o.ends)


def q_stream_stage_final(spark, sf_dir):
    from rampstat.streaming.live import stream_stage_final_table
    return with_ntz(stream_stage_final_table(spark, sf_dir), ("window_start", "window_end"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalized_requests": q_normalized_requests,
    "stage_metrics": q_stage_metrics,
    "stage_metrics_rpm": q_stage_metrics_rpm,
    "stage_metrics_observed": q_stage_metrics_observed,
    "percentiles_histogram": q_percentiles_histogram,
    "percentiles_disc": q_percentiles_disc,
    "model_summary": q_model_summary,
    "run_summary": q_run_summary,
    "stored_run_summary": q_stored_run_summary,
    "multi_grain_rollup": q_multi_grain_rollup,
    "raw_report": q_raw_report,
    "raw_report_head": q_raw_report_head,
    "error_report": q_error_report,
    "error_report_all": q_error_report_all,
    "rate_series": q_rate_series,
    "scale_decision": q_scale_decision,
    "off_scale_notes": q_off_scale_notes,
    "latency_series": q_latency_series,
    "error_rate_series": q_error_rate_series,
    "stage_pass_flags": q_stage_pass_flags,
    "model_scatter": q_model_scatter,
    "ramp_schedule": q_ramp_schedule,
    "schedule_offsets": q_schedule_offsets,
    "assign_round_robin": q_assign_round_robin,
    "assign_weighted": q_assign_weighted,
    "assign_duplicate": q_assign_duplicate,
    "assign_credential": q_assign_credential,
    "assign_prompt": q_assign_prompt,
    "allocated_rates": q_allocated_rates,
    "progress_running": q_progress_running,
    "pacing_gaps": q_pacing_gaps,
    "latest_snapshot": q_latest_snapshot,
    "config_audit": q_config_audit,
    "config_range_audit": q_config_range_audit,
    "config_key_values": q_config_key_values,
    "configs_without_credentials": q_configs_without_credentials,
    "config_overview": q_config_overview,
    "rate_texts": q_rate_texts,
    "run_status": q_run_status,
    "prompt_catalogue": q_prompt_catalogue,
    "suite_coverage": q_suite_coverage,
    "suite_counts": q_suite_counts,
    "suite_coverage_segments": q_suite_coverage_segments,
    "suite_prompts": q_suite_prompts,
    "config_range_audit_wide": q_config_range_audit_wide,
    "live_progress": q_live_progress,
    "request_payloads": q_request_payloads,
    "credential_tokens": q_credential_tokens,
    "credential_rejects": q_credential_rejects,
    "stream_progress": q_stream_progress,
    "stream_stage_final": q_stream_stage_final,
    "stream_latest_snapshot": q_stream_latest_snapshot,
    "config_json": q_config_json,
    "stage_report": q_stage_report,
    "approx_percentiles": q_approx_percentiles,
    "sketched_percentiles": q_sketched_percentiles,
    "incremental_rollup": q_incremental_rollup,
    "bundle_config": _bundle("config"),
    "bundle_stage_summary": _bundle("stage_summary"),
    "bundle_model_summary": _bundle("model_summary"),
    "bundle_raw_requests": _bundle("raw_requests"),
    "bundle_errors": _bundle("errors"),
    "bundle_rate_series": _bundle("rate_series"),
    "credential_file_tokens": q_credential_file_tokens,
    "order_requests": q_order_requests,
    "order_stage_metrics": q_order_stage_metrics,
    "order_scale_decision": q_order_scale_decision,
    "order_round_robin": q_order_round_robin,
    "order_weighted": q_order_weighted,
    "order_duplicate": q_order_duplicate,
    "order_credentials": q_order_credentials,
    "order_run_status": q_order_run_status,
}
