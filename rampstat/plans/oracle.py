"""SQL oracle (DuckDB dialect) for every driver query with a SQL form.

The base CTEs restate the fixture mapping (FIXTURES.md, part C) in SQL; the
per-query tails restate each operator's semantics. Floor-rank percentiles
use ``percentile_disc(1-p) WITHIN GROUP (ORDER BY x DESC)``; report rounding
uses ``round_even`` (the Spark side computes ``rint(x*10^d)/10^d``, the same
IEEE steps).
"""

from __future__ import annotations

from rampstat.schema import SUITE_DESCRIPTIONS, SUITES

_SUITE_LIST = "[" + ", ".join(f"'{s}'" for s in SUITES) + "]"

BASE = f"""
WITH RECURSIVE
ev AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
raw AS (
  SELECT user_id % 4 AS run_id, event_id, ts,
         'model_' || CAST(user_id % 3 AS VARCHAR) AS model,
         CAST(CASE user_id % 3 WHEN 0 THEN 70.0 WHEN 1 THEN 30.0 ELSE 0.0 END AS DOUBLE) AS model_percentage,
         user_id AS token_index,
         CASE WHEN user_id % 10 = 0 THEN '' ELSE 'acct-' || CAST(user_id AS VARCHAR) END AS raw_label,
         {_SUITE_LIST}[event_id % 7 + 1] AS suite_id,
         CAST(CASE WHEN event_type = 'error' AND k % 3 IN (0, 1) THEN NULL
                   WHEN event_type = 'error' AND k % 3 = 2 AND k % 2 = 0 THEN 500
                   WHEN event_type = 'error' AND k % 3 = 2 THEN 429
                   WHEN event_type = 'signup' AND k % 10 = 0 THEN 302
                   ELSE 200 END AS INTEGER) AS raw_code,
         CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'timeout'
              WHEN event_type = 'error' AND k % 3 = 1 THEN 'ConnectError' END AS raw_exception,
         value AS raw_latency
  FROM ev),
runs AS (SELECT user_id % 4 AS run_id, COUNT(DISTINCT user_id) AS n_tokens FROM events GROUP BY 1),
ramp(stage_index, raw_rate) AS (
  SELECT 0, CAST(0.001 AS DOUBLE)
  UNION ALL
  SELECT stage_index + 1, raw_rate * CAST(2.0 AS DOUBLE) FROM ramp
  WHERE raw_rate < CAST(0.512 AS DOUBLE) AND raw_rate * CAST(2.0 AS DOUBLE) > raw_rate),
sched AS (
  SELECT r.run_id, CAST(p.stage_index AS INTEGER) AS stage_index,
         LEAST(p.raw_rate, CAST(0.512 AS DOUBLE)) AS target_rps,
         CAST(LEAST(1 + p.stage_index * 1, 5, r.n_tokens) AS INTEGER) AS active_users,
         CAST(259200.0 AS DOUBLE) AS duration,
         CAST(p.stage_index AS DOUBLE) * CAST(259200.0 AS DOUBLE) AS t0_offset_s
  FROM runs r CROSS JOIN ramp p),
norm AS (
  SELECT run_id, event_id, ts, model, model_percentage, token_index, suite_id,
         COALESCE(NULLIF(raw_label, ''), 'user-' || CAST(token_index AS VARCHAR)) AS token_label,
         CASE WHEN raw_exception = 'timeout' THEN 'timeout'
              WHEN raw_exception IS NOT NULL THEN 'error'
              WHEN raw_code BETWEEN 200 AND 399 THEN 'success'
              ELSE 'failure' END AS status,
         CASE WHEN raw_exception IS NULL THEN raw_code END AS status_code,
         CASE WHEN raw_exception IS NULL THEN raw_latency ELSE CAST(0.0 AS DOUBLE) END AS latency_ms,
         raw_exception AS error_type,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) // 259200000000 AS slot,
         epoch_us(ts) >= epoch_us(TIMESTAMP '2024-01-01 00:00:00') AS after_start
  FROM raw),
req AS (
  SELECT n.run_id,
         row_number() OVER (PARTITION BY n.run_id ORDER BY n.ts, n.event_id) AS seq,
         n.event_id, n.ts, s.stage_index, n.model, n.model_percentage, n.token_index,
         n.token_label, s.active_users, s.target_rps, n.status, n.status_code, n.latency_ms,
         n.error_type, n.suite_id, CAST(s.stage_index AS VARCHAR) AS prompt_id
  FROM norm n LEFT JOIN sched s
    ON s.run_id = n.run_id AND n.after_start AND s.stage_index = n.slot),
agg AS (
  SELECT run_id, stage_index, COUNT(*) AS n,
         COUNT(*) FILTER (WHERE status = 'success') AS ok,
         AVG(latency_ms) AS avg_l,
         percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms DESC) AS p50,
         percentile_disc(0.05) WITHIN GROUP (ORDER BY latency_ms DESC) AS p95,
         percentile_disc(0.01) WITHIN GROUP (ORDER BY latency_ms DESC) AS p99
  FROM req WHERE stage_index IS NOT NULL GROUP BY run_id, stage_index),
sm AS (
  SELECT s.run_id, s.stage_index, s.duration AS elapsed_seconds, s.target_rps,
         CASE WHEN COALESCE(a.n, 0) > 0
              THEN CAST(a.n AS DOUBLE) / GREATEST(s.duration, CAST(0.001 AS DOUBLE))
              ELSE CAST(0.0 AS DOUBLE) END AS achieved_rps,
         s.active_users,
         CAST(COALESCE(a.n, 0) AS BIGINT) AS total_requests,
         CAST(COALESCE(a.ok, 0) AS BIGINT) AS successful,
         CAST(COALESCE(a.n - a.ok, 0) AS BIGINT) AS failed,
         COALESCE(round_even(a.avg_l, 6), CAST(0.0 AS DOUBLE)) AS avg_latency_ms,
         COALESCE(a.p50, CAST(0.0 AS DOUBLE)) AS p50_latency_ms,
         COALESCE(a.p95, CAST(0.0 AS DOUBLE)) AS p95_latency_ms,
         COALESCE(a.p99, CAST(0.0 AS DOUBLE)) AS p99_latency_ms,
         CASE WHEN COALESCE(a.n, 0) > 0 THEN CAST(a.n - a.ok AS DOUBLE) / CAST(a.n AS DOUBLE)
              ELSE CAST(0.0 AS DOUBLE) END AS error_rate
  FROM sched s LEFT JOIN agg a ON a.run_id = s.run_id AND a.stage_index = s.stage_index)
"""

_PROFILE = """
  COUNT(*) AS total_requests,
  CAST(COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS successful,
  CAST(COUNT(*) - COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS failed,
  round_even(AVG(latency_ms), 6) AS avg_latency_ms,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY latency_ms DESC) AS p50_latency_ms,
  percentile_disc(0.05) WITHIN GROUP (ORDER BY latency_ms DESC) AS p95_latency_ms,
  percentile_disc(0.01) WITHIN GROUP (ORDER BY latency_ms DESC) AS p99_latency_ms
"""

CONFIG_BASE = f"""
cfg0 AS (
  SELECT c_custkey AS c, c_nationkey, c_mktsegment FROM customer),
cfg AS (
  SELECT c AS run_id,
         'http://host-' || CAST(c % 3 AS VARCHAR) || '.local' || CASE WHEN c % 2 = 0 THEN '/' ELSE '' END AS base_url,
         CASE WHEN c % 3 = 0 THEN '/v1/chat/completions/' ELSE 'v1/chat/completions' END AS api_path,
         CAST(c % 9 AS INTEGER) AS token_count,
         CAST(c % 4 AS INTEGER) AS model_count,
         CASE WHEN c % 2 = 1 THEN 'rpm' ELSE 'rps' END AS rate_unit,
         CAST(c % 20 AS DOUBLE) AS initial_display,
         CAST((c % 100) - 5 AS DOUBLE) AS max_display,
         CASE WHEN c % 2 = 1 THEN CAST(c % 20 AS DOUBLE) / CAST(60.0 AS DOUBLE) ELSE CAST(c % 20 AS DOUBLE) END AS initial_rate,
         CASE WHEN c % 2 = 1 THEN CAST((c % 100) - 5 AS DOUBLE) / CAST(60.0 AS DOUBLE) ELSE CAST((c % 100) - 5 AS DOUBLE) END AS max_rate,
         CAST(c_nationkey % 6 AS INTEGER) AS min_users,
         CAST(c % 12 AS INTEGER) AS max_users,
         CAST(c % 4 AS INTEGER) AS users_increment,
         CAST(1.0 AS DOUBLE) + CAST(c % 5 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS scaling_factor,
         CAST((c % 7) * 10 AS DOUBLE) AS time_increment,
         {_SUITE_LIST}[c % 7 + 1] AS benchmark_suite,
         CAST(60.0 AS DOUBLE) AS timeout,
         c_mktsegment = 'BUILDING' AS is_public
  FROM cfg0),
cfg_models AS (
  SELECT run_id, i AS model_pos,
         CASE WHEN (run_id + i) % 11 = 0 THEN '' ELSE 'model_' || CAST(i AS VARCHAR) END AS model,
         CAST(CASE WHEN (run_id + i) % 17 = 0 THEN 150.0 WHEN (run_id + i) % 2 = 0 THEN 100.0
                   WHEN (run_id + i) % 3 = 0 THEN 50.0 ELSE 0.0 END AS DOUBLE) AS percentage
  FROM cfg, range(1, model_count + 1) t(i)),
cfg_tokens AS (
  SELECT run_id, i AS token_pos, 'sk-' || CAST(run_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS token,
         CASE WHEN (run_id + i) % 5 = 0 THEN '' ELSE 'key-' || CAST(i AS VARCHAR) END AS label
  FROM cfg, range(1, token_count + 1) t(i))
"""


def _q(tail: str) -> str:
    return BASE + tail


def _c(tail: str) -> str:
    return "WITH RECURSIVE " + CONFIG_BASE + tail


ORACLE: dict[str, str] = {}

ORACLE["normalized_requests"] = _q("""
SELECT run_id, seq, event_id, ts, stage_index, model, model_percentage, token_index, token_label,
       active_users, target_rps, status, status_code, latency_ms, error_type, suite_id, prompt_id
FROM req""")

ORACLE["stage_metrics"] = _q("SELECT * FROM sm")

ORACLE["stage_metrics_rpm"] = _q("""
SELECT run_id, stage_index, elapsed_seconds,
       round_even(target_rps * CAST(60.0 AS DOUBLE), 4) AS target_rpm,
       round_even(achieved_rps * CAST(60.0 AS DOUBLE), 4) AS achieved_rpm,
       printf('%.1f RPM', round_even(target_rps * CAST(60.0 AS DOUBLE), 1)) AS target_label,
       active_users, total_requests, successful, failed, avg_latency_ms,
       p50_latency_ms, p95_latency_ms, p99_latency_ms, error_rate
FROM sm""")

_PCT = _q("""
SELECT run_id, stage_index, CAST(n AS BIGINT) AS n, p50 AS p50_latency_ms, p95 AS p95_latency_ms,
       p99 AS p99_latency_ms
FROM agg""")
ORACLE["percentiles_histogram"] = _PCT
ORACLE["percentiles_disc"] = _PCT
ORACLE["approx_percentiles"] = _q("""
SELECT run_id, stage_index, CAST(COUNT(*) AS BIGINT) AS n, TRUE AS p50_within, TRUE AS p95_within, TRUE AS p99_within
FROM req WHERE stage_index IS NOT NULL GROUP BY run_id, stage_index""")

ORACLE["model_summary"] = _q(f""",
ms AS (
  SELECT run_id, model, MIN(seq) AS first_seq, {_PROFILE}
  FROM req GROUP BY run_id, model)
SELECT run_id, model, CAST(first_seq AS BIGINT) AS first_seq, CAST(total_requests AS BIGINT) AS total_requests,
       successful, failed,
       CASE WHEN total_requests > 0 THEN CAST(successful AS DOUBLE) / CAST(total_requests AS DOUBLE)
            ELSE CAST(0.0 AS DOUBLE) END AS success_rate,
       avg_latency_ms, p50_latency_ms, p95_latency_ms, p99_latency_ms
FROM ms""")

ORACLE["run_summary"] = _q("""
SELECT run_id, CAST(COUNT(*) AS BIGINT) AS total_requests,
       CAST(COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS successful,
       CAST(COUNT(*) - COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS failed,
       COALESCE(round_even(AVG(latency_ms), 6), CAST(0.0 AS DOUBLE)) AS avg_latency_ms
FROM req GROUP BY run_id""")

ORACLE["multi_grain_rollup"] = _q(f""",
g AS (
  SELECT GROUPING(stage_index) AS gs, GROUPING(model) AS gm, run_id, stage_index, model, {_PROFILE}
  FROM req GROUP BY GROUPING SETS ((run_id), (run_id, stage_index), (run_id, model)))
SELECT CASE WHEN gs = 1 AND gm = 1 THEN 'run' WHEN gm = 1 THEN 'stage' ELSE 'model' END AS grain,
       run_id, stage_index, model, CAST(total_requests AS BIGINT) AS total_requests, successful, failed,
       avg_latency_ms, p50_latency_ms, p95_latency_ms, p99_latency_ms
FROM g""")

_RAW = """,
raw_rep AS (
  SELECT r.run_id, r.seq, r.stage_index AS stage, r.model, r.token_index AS token_idx, r.token_label,
         r.active_users, round_even(r.target_rps, 2) AS target_rps,
         round_even(COALESCE(m.achieved_rps, CAST(0.0 AS DOUBLE)), 2) AS achieved_rps,
         r.status, r.status_code, round_even(r.latency_ms, 2) AS latency_ms,
         COALESCE(r.error_type, '') AS error_type, r.suite_id, r.prompt_id
  FROM req r LEFT JOIN sm m ON m.run_id = r.run_id AND m.stage_index = r.stage_index)
"""
ORACLE["raw_report"] = _q(_RAW + "SELECT * FROM raw_rep")
ORACLE["raw_report_head"] = _q(_RAW + "SELECT * FROM raw_rep ORDER BY run_id, seq LIMIT 100")

ORACLE["error_report"] = _q("""
SELECT run_id, seq, stage_index, model, status_code, error_type, active_users
FROM req WHERE status <> 'success' AND error_type IS NOT NULL""")
ORACLE["error_report_all"] = _q("""
SELECT run_id, seq, stage_index, model, status_code, error_type, active_users
FROM req WHERE status <> 'success'""")

ORACLE["rate_series"] = _q("""
SELECT run_id, stage_index, active_users, total_requests, 'Target RPM' AS series,
       target_rps * CAST(60.0 AS DOUBLE) AS rpm FROM sm
UNION ALL
SELECT run_id, stage_index, active_users, total_requests, 'Achieved RPM' AS series,
       achieved_rps * CAST(60.0 AS DOUBLE) AS rpm FROM sm""")

_SCALE = """,
peaks AS (
  SELECT run_id, MAX(target_rps * CAST(60.0 AS DOUBLE)) AS target_max,
         arg_min(stage_index, (-(target_rps * CAST(60.0 AS DOUBLE)), stage_index)) AS target_peak_stage,
         MAX(achieved_rps * CAST(60.0 AS DOUBLE)) AS achieved_max
  FROM sm GROUP BY run_id),
scale AS (
  SELECT run_id, target_max, CAST(target_peak_stage AS INTEGER) AS target_peak_stage, achieved_max,
         CASE WHEN achieved_max <= 0 THEN target_max > 0 ELSE target_max / achieved_max > 10.0 END
           AS use_achieved_scale,
         CASE WHEN achieved_max <= 0 THEN CAST(1.0 AS DOUBLE)
              WHEN target_max / achieved_max > 10.0
                THEN GREATEST(CAST(1.0 AS DOUBLE), achieved_max * CAST(1.15 AS DOUBLE))
              ELSE GREATEST(target_max, achieved_max) END AS y_max
  FROM peaks)
"""
ORACLE["scale_decision"] = _q(_SCALE + "SELECT * FROM scale")
ORACLE["off_scale_notes"] = _q(_SCALE + """
SELECT run_id, 'marker' AS kind, target_peak_stage AS stage_index, y_max AS rpm, CAST(NULL AS VARCHAR) AS note
FROM scale WHERE use_achieved_scale
UNION ALL
SELECT run_id, 'note' AS kind, target_peak_stage AS stage_index, y_max * CAST(0.98 AS DOUBLE) AS rpm,
       printf('Target peak: %.2f RPM (off-scale)', round_even(target_max, 2)) AS note
FROM scale WHERE use_achieved_scale""")

ORACLE["latency_series"] = _q("""
SELECT run_id, stage_index, 'P50' AS series, p50_latency_ms AS latency_ms FROM sm
UNION ALL SELECT run_id, stage_index, 'P95', p95_latency_ms FROM sm
UNION ALL SELECT run_id, stage_index, 'P99', p99_latency_ms FROM sm""")

ORACLE["error_rate_series"] = _q("""
SELECT run_id, stage_index, total_requests, error_rate * CAST(100.0 AS DOUBLE) AS error_rate_pct FROM sm""")

ORACLE["stage_pass_flags"] = _q("""
SELECT run_id, stage_index, total_requests, successful,
       CASE WHEN total_requests > 0 THEN CAST(successful AS DOUBLE) / CAST(total_requests AS DOUBLE)
            ELSE CAST(0.0 AS DOUBLE) END AS success_rate,
       (CASE WHEN total_requests > 0 THEN CAST(successful AS DOUBLE) / CAST(total_requests AS DOUBLE)
             ELSE CAST(0.0 AS DOUBLE) END) >= CAST(0.8 AS DOUBLE) AS passed
FROM sm""")

ORACLE["model_scatter"] = _q(f""",
ms AS (SELECT run_id, model, {_PROFILE} FROM req GROUP BY run_id, model)
SELECT run_id, model, CAST(total_requests AS BIGINT) AS total_requests, avg_latency_ms, p95_latency_ms,
       CAST(successful AS DOUBLE) / CAST(total_requests AS DOUBLE) AS success_rate
FROM ms""")

_RANGES = """,
pct_bad AS (SELECT run_id, COUNT(*) AS n FROM cfg_models WHERE percentage < 0 OR percentage > 100 GROUP BY run_id),
ranges AS (
SELECT run_id, 'initial_rate_range' AS rule, CAST(initial_display AS VARCHAR) AS value FROM cfg
  WHERE NOT (initial_display BETWEEN 1 AND 2000)
UNION ALL SELECT run_id, 'max_rate_range', CAST(max_display AS VARCHAR) FROM cfg WHERE NOT (max_display BETWEEN 1 AND 2000)
UNION ALL SELECT run_id, 'max_below_initial', CAST(max_display AS VARCHAR) FROM cfg WHERE max_display < initial_display
UNION ALL SELECT run_id, 'scaling_factor_range', CAST(scaling_factor AS VARCHAR) FROM cfg
  WHERE NOT (scaling_factor BETWEEN 1.1 AND 10.0)
UNION ALL SELECT run_id, 'time_increment_range', CAST(time_increment AS VARCHAR) FROM cfg
  WHERE NOT (time_increment BETWEEN 5 AND 300)
UNION ALL SELECT run_id, 'model_count_range', CAST(model_count AS VARCHAR) FROM cfg WHERE model_count > 10
UNION ALL SELECT run_id, 'percentage_range', CAST(n AS VARCHAR) FROM pct_bad
UNION ALL SELECT run_id, 'timeout_range', CAST(timeout AS VARCHAR) FROM cfg WHERE NOT (timeout BETWEEN 1 AND 600)
UNION ALL SELECT run_id, 'users_over_token_cap', CAST(max_users AS VARCHAR) FROM cfg
  WHERE token_count > 0 AND max_users > LEAST(token_count, 100))
"""
_RAMP = """,
ramp_c(run_id, stage_index, raw_rate) AS (
  SELECT run_id, 0, initial_rate FROM cfg
  UNION ALL
  SELECT r.run_id, r.stage_index + 1, r.raw_rate * c.scaling_factor
  FROM ramp_c r JOIN cfg c ON c.run_id = r.run_id
  WHERE r.raw_rate < c.max_rate AND r.raw_rate * c.scaling_factor > r.raw_rate),
sched_c AS (
  SELECT r.run_id, CAST(r.stage_index AS INTEGER) AS stage_index, LEAST(r.raw_rate, c.max_rate) AS target_rps,
         CAST(LEAST(c.min_users + r.stage_index * c.users_increment, c.max_users) AS INTEGER) AS active_users,
         c.time_increment AS duration
  FROM ramp_c r JOIN cfg c ON c.run_id = r.run_id)
"""
ORACLE["ramp_schedule"] = _c(_RAMP + "SELECT * FROM sched_c")
ORACLE["schedule_offsets"] = _c(_RAMP + """
SELECT run_id, stage_index,
       CAST(stage_index AS DOUBLE) * duration AS t0_offset_s,
       CAST(stage_index AS DOUBLE) * duration + duration AS t1_offset_s,
       CAST(COUNT(*) OVER (PARTITION BY run_id) AS BIGINT) AS total_stages
FROM sched_c""")

ORACLE["assign_round_robin"] = _q("""
SELECT run_id, seq, model,
       CASE WHEN seq % 2 = 0 THEN 'model_0' ELSE 'model_1' END AS assigned_model,
       CAST(CASE WHEN seq % 2 = 0 THEN 70.0 ELSE 30.0 END AS DOUBLE) AS assigned_percentage
FROM req""")
ORACLE["assign_duplicate"] = ORACLE["assign_round_robin"]
ORACLE["assign_weighted"] = _q("""
SELECT run_id, seq, model,
       CASE WHEN seq % 100 < 70 THEN 'model_0' ELSE 'model_1' END AS assigned_model,
       CAST(CASE WHEN seq % 100 < 70 THEN 70.0 ELSE 30.0 END AS DOUBLE) AS assigned_percentage
FROM req""")

ORACLE["assign_credential"] = _q(""",
users AS (SELECT DISTINCT run_id, token_index, raw_label FROM raw),
toks AS (
  SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY token_index) - 1 AS token_pos,
         'sk-' || CAST(token_index AS VARCHAR) AS token, raw_label AS label FROM users),
ntok AS (SELECT run_id, COUNT(*) AS n FROM toks GROUP BY run_id),
ri AS (SELECT r.run_id, r.seq, CAST(CASE WHEN n.n > 0 THEN r.seq % n.n ELSE 0 END AS BIGINT) AS token_idx, n.n
       FROM req r LEFT JOIN ntok n ON n.run_id = r.run_id)
SELECT ri.run_id, ri.seq, ri.token_idx,
       CASE WHEN COALESCE(ri.n, 0) = 0 THEN 'public'
            ELSE COALESCE(NULLIF(t.label, ''), 'user-' || CAST(ri.token_idx AS VARCHAR)) END AS assigned_label,
       sha256(t.token) AS token_sha256
FROM ri LEFT JOIN toks t ON t.run_id = ri.run_id AND t.token_pos = ri.token_idx""")

_PROMPTS = f""",
prompts AS (
  SELECT {_SUITE_LIST}[item_id % 6 + 1] AS suite_id, item_id // 6 AS prompt_index, text FROM benchmark),
np AS (SELECT suite_id, COUNT(*) AS n FROM prompts GROUP BY suite_id),
rp AS (
  SELECT r.*, CAST(CASE WHEN np.n > 0 THEN r.seq % np.n ELSE 0 END AS BIGINT) AS prompt_index_a, np.n AS np_n
  FROM req r LEFT JOIN np ON np.suite_id = r.suite_id),
ap AS (
  SELECT rp.*, CASE WHEN rp.np_n > 0 THEN rp.suite_id || '-' || CAST(rp.prompt_index_a + 1 AS VARCHAR) END
           AS assigned_prompt_id,
         COALESCE(p.text, '') AS prompt_text
  FROM rp LEFT JOIN prompts p ON p.suite_id = rp.suite_id AND p.prompt_index = rp.prompt_index_a)
"""
ORACLE["assign_prompt"] = _q(_PROMPTS + """
SELECT run_id, seq, suite_id, prompt_index_a AS prompt_index, assigned_prompt_id, prompt_text FROM ap""")

ORACLE["request_payloads"] = _q(_PROMPTS + """
SELECT run_id, seq, model, 'user' AS role, CAST(length(prompt_text) AS BIGINT) AS content_chars,
       1 AS n_messages, false AS stream, CAST(0.0 AS DOUBLE) AS temperature FROM ap""")

ORACLE["allocated_rates"] = _q(""",
am AS (SELECT * FROM (VALUES ('model_0', 70.0), ('model_1', 30.0)) t(model, percentage))
SELECT s.run_id, s.stage_index, am.model, CAST(am.percentage AS DOUBLE) AS percentage, s.target_rps,
       s.target_rps * CAST(am.percentage AS DOUBLE) / CAST(100.0 AS DOUBLE) AS allocated_rps
FROM sched s CROSS JOIN am""")

ORACLE["progress_running"] = _q(""",
ps AS (
  SELECT r.run_id, r.stage_index, r.target_rps, r.active_users, s.t0_offset_s, s.duration,
         COUNT(*) OVER w AS stage_count,
         COUNT(*) FILTER (WHERE r.status = 'success') OVER w AS stage_successful,
         COUNT(*) OVER (PARTITION BY r.run_id ORDER BY r.ts, r.event_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total_metrics,
         CAST(epoch_us(r.ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')
              - CAST(s.t0_offset_s * CAST(1000000.0 AS DOUBLE) AS BIGINT) AS DOUBLE)
           / CAST(1000000.0 AS DOUBLE) AS stage_elapsed_s
  FROM req r JOIN sched s ON s.run_id = r.run_id AND s.stage_index = r.stage_index
  WINDOW w AS (PARTITION BY r.run_id, r.stage_index ORDER BY r.ts, r.event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
nst AS (SELECT run_id, COUNT(*) AS total_stages FROM sched GROUP BY run_id),
rows_ AS (
  SELECT p.run_id, CAST(p.total_metrics AS BIGINT) AS seq, p.stage_index,
         CAST(p.stage_index + 1 AS INTEGER) AS stage_number,
         CAST(p.stage_count AS BIGINT) AS stage_count, CAST(p.stage_successful AS BIGINT) AS stage_successful,
         CAST(p.stage_count - p.stage_successful AS BIGINT) AS stage_failed,
         CAST(p.total_metrics AS BIGINT) AS total_metrics, p.target_rps, p.active_users, p.stage_elapsed_s,
         CAST(p.stage_count AS DOUBLE) / GREATEST(p.stage_elapsed_s, CAST(0.001 AS DOUBLE)) AS achieved_rps,
         (p.t0_offset_s + p.stage_elapsed_s) * CAST(1000.0 AS DOUBLE) AS elapsed_ms,
         LEAST((CAST(p.stage_index AS DOUBLE) + LEAST(p.stage_elapsed_s / GREATEST(p.duration, CAST(0.001 AS DOUBLE)),
                                        CAST(1.0 AS DOUBLE)))
               / CAST(GREATEST(n.total_stages, 1) AS DOUBLE), CAST(1.0 AS DOUBLE)) AS progress_fraction,
         CAST(p.stage_count AS DOUBLE) / GREATEST(p.stage_elapsed_s, CAST(0.001 AS DOUBLE)) - p.target_rps
           AS rate_delta
  FROM ps p JOIN nst n ON n.run_id = p.run_id)
SELECT * FROM rows_
UNION ALL
SELECT s.run_id, CAST(0 AS BIGINT), 0, 1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
       CAST(0 AS BIGINT), s.target_rps, s.active_users, CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE),
       CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE), CAST(0.0 AS DOUBLE) - s.target_rps
FROM sched s WHERE s.stage_index = 0 AND s.run_id IN (SELECT run_id FROM req WHERE stage_index IS NOT NULL)""")

ORACLE["pacing_gaps"] = _q("""
SELECT run_id, seq, stage_index,
       CAST(epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY run_id, stage_index ORDER BY ts, event_id)) AS DOUBLE)
         / CAST(1000000.0 AS DOUBLE) AS gap_s,
       CAST(1.0 AS DOUBLE) / GREATEST(target_rps, CAST(1e-6 AS DOUBLE)) AS planned_interval_s,
       CAST(1.0 AS DOUBLE) / GREATEST(target_rps, CAST(1e-6 AS DOUBLE))
         - CAST(epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY run_id, stage_index ORDER BY ts, event_id)) AS DOUBLE)
           / CAST(1000000.0 AS DOUBLE) AS slack_s
FROM req WHERE stage_index IS NOT NULL""")

ORACLE["latest_snapshot"] = _q(""",
last AS (
  SELECT run_id, arg_max(stage_index, (ts, event_id)) AS stage_index, MAX(ts) AS last_ts,
         arg_max(target_rps, (ts, event_id)) AS target_rps, arg_max(active_users, (ts, event_id)) AS active_users,
         CAST(COUNT(*) AS BIGINT) AS total_metrics
  FROM req GROUP BY run_id),
st AS (
  SELECT run_id, stage_index, CAST(COUNT(*) AS BIGINT) AS stage_count,
         CAST(COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS stage_successful
  FROM req GROUP BY run_id, stage_index)
SELECT l.run_id, l.stage_index, l.total_metrics, st.stage_count, st.stage_successful,
       st.stage_count - st.stage_successful AS stage_failed, l.target_rps, l.active_users, l.last_ts,
       CAST(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(l.last_ts) AS DOUBLE) / CAST(1000000.0 AS DOUBLE)
         AS age_s
FROM last l LEFT JOIN st ON st.run_id = l.run_id AND st.stage_index = l.stage_index""")

ORACLE["config_audit"] = _c(""",
msgs AS (
  SELECT run_id, 0 AS grp, 0 AS pos, 'token_count' AS rule,
         'min_users (' || CAST(min_users AS VARCHAR) || ') exceeds token count (' || CAST(token_count AS VARCHAR)
           || '). Truncate to token count.' AS message
  FROM cfg WHERE token_count > 0 AND min_users > token_count
  UNION ALL
  SELECT run_id, 0, 1, 'no_usable_tokens', 'No usable tokens (token_count=' || CAST(token_count AS VARCHAR) || ')'
  FROM cfg WHERE token_count > 0 AND LEAST(max_users, token_count) < 1
  UNION ALL
  SELECT run_id, 1, 0, 'no_models', 'At least one model must be configured.' FROM cfg WHERE model_count = 0
  UNION ALL
  SELECT run_id, 1, model_pos,
         CASE WHEN trim(model) = '' THEN 'blank_model_name' ELSE 'model_percentage' END,
         CASE WHEN trim(model) = '' THEN 'All models must have a non-empty name.'
              ELSE 'Model ''' || model || ''': percentage must be 0-100.' END
  FROM cfg_models WHERE trim(model) = '' OR percentage < 0 OR percentage > 100
  UNION ALL
  SELECT run_id, 1, 1000, 'multiple_full_models',
         'Multiple models at 100% detected (' || string_agg(model, ', ' ORDER BY model) ||
         '). Each will receive 100% of load (duplicated traffic).'
  FROM cfg_models WHERE percentage = 100 GROUP BY run_id HAVING COUNT(*) >= 2
  UNION ALL
  SELECT run_id, 2, 0, 'initial_rate', 'Initial ' || upper(rate_unit) || ' must be > 0' FROM cfg WHERE initial_rate <= 0
  UNION ALL
  SELECT run_id, 2, 1, 'max_rate', 'Max ' || upper(rate_unit) || ' must be >= Initial ' || upper(rate_unit)
  FROM cfg WHERE max_rate < initial_rate
  UNION ALL
  SELECT run_id, 2, 2, 'scaling_factor', 'Scaling factor must be > 1.0' FROM cfg WHERE scaling_factor <= 1.0
  UNION ALL
  SELECT run_id, 2, 3, 'time_increment', 'Time increment must be > 0' FROM cfg WHERE time_increment <= 0
  UNION ALL
  SELECT run_id, 3, 0, 'min_users', 'min_users must be >= 1' FROM cfg WHERE min_users < 1
  UNION ALL
  SELECT run_id, 3, 1, 'max_users', 'max_users must be >= min_users' FROM cfg WHERE max_users < min_users
  UNION ALL
  SELECT run_id, 3, 2, 'users_increment', 'users_increment must be >= 1' FROM cfg WHERE users_increment < 1)
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY grp, pos) - 1 AS INTEGER) AS msg_index,
       rule, message
FROM msgs""")

ORACLE["config_range_audit"] = _c(_RANGES + "SELECT * FROM ranges")

ORACLE["config_key_values"] = _c(""",
kv AS (
  SELECT run_id, 1 AS ordinal, 'base_url' AS key, base_url AS value FROM cfg
  UNION ALL SELECT run_id, 2, 'api_path', api_path FROM cfg
  UNION ALL SELECT run_id, 3, 'rate_unit', rate_unit FROM cfg
  UNION ALL SELECT run_id, 4, 'initial_rate_rps', printf('%.6f', round_even(initial_rate, 6)) FROM cfg
  UNION ALL SELECT run_id, 5, 'max_rate_rps', printf('%.6f', round_even(max_rate, 6)) FROM cfg
  UNION ALL SELECT run_id, 6, 'scaling_factor', printf('%.6f', round_even(scaling_factor, 6)) FROM cfg
  UNION ALL SELECT run_id, 7, 'time_increment_s', printf('%.6f', round_even(time_increment, 6)) FROM cfg
  UNION ALL SELECT run_id, 8, 'min_users', CAST(min_users AS VARCHAR) FROM cfg
  UNION ALL SELECT run_id, 9, 'max_users', CAST(max_users AS VARCHAR) FROM cfg
  UNION ALL SELECT run_id, 10, 'users_increment', CAST(users_increment AS VARCHAR) FROM cfg
  UNION ALL SELECT run_id, 11, 'benchmark_suite', benchmark_suite FROM cfg
  UNION ALL SELECT run_id, 12, 'timeout_s', printf('%.6f', round_even(timeout, 6)) FROM cfg
  UNION ALL SELECT run_id, 13, 'model_count', CAST(model_count AS VARCHAR) FROM cfg
  UNION ALL SELECT run_id, 14, 'token_count', CAST(token_count AS VARCHAR) FROM cfg)
SELECT run_id, CAST(ordinal AS INTEGER) AS ordinal, key, value FROM kv""")

ORACLE["configs_without_credentials"] = _c("""
SELECT run_id FROM cfg WHERE NOT is_public AND token_count = 0""")

_DESC_VALUES = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in SUITE_DESCRIPTIONS.items())
ORACLE["config_overview"] = _c(f""",
descs AS (SELECT * FROM (VALUES {_DESC_VALUES}) t(suite_id, label, detail)),
full_m AS (
  SELECT run_id, string_agg(model, ', ' ORDER BY model) AS full_models
  FROM cfg_models WHERE percentage = 100 GROUP BY run_id)
SELECT c.run_id, c.benchmark_suite,
       rtrim(c.base_url, '/') || '/' || trim(c.api_path, '/') AS endpoint,
       CAST(CASE WHEN NOT c.is_public AND c.token_count > 0 THEN LEAST(c.min_users, c.token_count)
                 ELSE c.min_users END AS INTEGER) AS effective_users,
       c.model_count, c.token_count, COALESCE(f.full_models, '') AS full_models,
       COALESCE(d.label, 'Unknown') AS suite_label, COALESCE(d.detail, '') AS suite_detail
FROM cfg c LEFT JOIN full_m f ON f.run_id = c.run_id LEFT JOIN descs d ON d.suite_id = c.benchmark_suite""")

ORACLE["run_status"] = _q(""",
planned AS (SELECT run_id, CAST(COUNT(*) AS BIGINT) AS planned_stages, MAX(stage_index) AS last_stage
            FROM sched GROUP BY run_id),
seen AS (SELECT run_id, CAST(COUNT(DISTINCT stage_index) AS BIGINT) AS observed_stages,
                MAX(stage_index) AS seen_last FROM req WHERE stage_index IS NOT NULL GROUP BY run_id)
SELECT p.run_id, p.planned_stages, COALESCE(s.observed_stages, 0) AS observed_stages,
       CASE WHEN s.seen_last = p.last_stage THEN 'completed' ELSE 'running' END AS run_status,
       '' AS error_message
FROM planned p LEFT JOIN seen s ON s.run_id = p.run_id""")

_SUITES_VALUES = ", ".join(
    f"({i}, '{s}', '{SUITE_DESCRIPTIONS[s][0]}', '{SUITE_DESCRIPTIONS[s][1]}')" for i, s in enumerate(SUITES))
_CAT = f"""
WITH suites AS (SELECT * FROM (VALUES {_SUITES_VALUES}) t(suite_order, suite_id, label, detail)),
prompts AS (
  SELECT {_SUITE_LIST}[item_id % 6 + 1] AS suite_id, item_id // 6 AS prompt_index, text FROM benchmark)
"""
ORACLE["prompt_catalogue"] = _CAT + """
SELECT CAST(s.suite_order AS INTEGER) AS suite_order, p.suite_id, p.prompt_index,
       p.suite_id || '-' || CAST(p.prompt_index + 1 AS VARCHAR) AS prompt_id,
       p.suite_id AS parsed_suite, p.prompt_index AS parsed_index, CAST(length(p.text) AS BIGINT) AS n_chars
FROM prompts p LEFT JOIN suites s ON s.suite_id = p.suite_id"""
ORACLE["suite_coverage"] = _CAT + """
SELECT suite_id, 'no_prompts' AS issue FROM suites WHERE suite_id NOT IN (SELECT suite_id FROM prompts)"""
ORACLE["suite_counts"] = _CAT + """,
cnt AS (SELECT suite_id, COUNT(*) AS n FROM prompts GROUP BY suite_id)
SELECT CAST(s.suite_order AS INTEGER) AS suite_order, s.suite_id, s.label, s.detail,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n_prompts, COALESCE(c.n, 0) > 0 AS has_prompts,
       (SELECT COUNT(DISTINCT label) = COUNT(label) FROM suites) AS labels_distinct,
       (SELECT COUNT(DISTINCT detail) = COUNT(detail) FROM suites) AS details_distinct
FROM suites s LEFT JOIN cnt c ON c.suite_id = s.suite_id"""

_CRED = """
WITH lines0 AS (
  SELECT c_nationkey AS file, c_custkey AS c, c_nationkey % 3 AS kind,
         CASE WHEN c_custkey % 13 = 0 THEN '' ELSE 'sk-' || CAST(c_custkey AS VARCHAR) END AS token,
         CASE WHEN c_custkey % 17 = 0 THEN '' ELSE c_name END AS label
  FROM customer),
body AS (
  SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY c) + CASE WHEN kind < 2 THEN 1 ELSE 0 END AS BIGINT)
           AS line_no,
         kind, token, label, c % 7 = 0 AS short
  FROM lines0),
parsed AS (
  SELECT file, line_no,
         CASE WHEN kind = 1 THEN (CASE WHEN short THEN '' ELSE token END) ELSE token END AS tok,
         CASE WHEN kind = 2 THEN 'token-' || CAST(line_no AS VARCHAR)
              WHEN short THEN 'user-' || CAST(line_no AS VARCHAR)
              ELSE label END AS label
  FROM body)
"""
ORACLE["credential_tokens"] = _CRED + """
SELECT CAST(file AS INTEGER) AS file, line_no, sha256(tok) AS token_sha256, label FROM parsed WHERE tok <> ''"""
ORACLE["credential_rejects"] = _CRED + """
SELECT CAST(file AS INTEGER) AS file, line_no, 'Row ' || CAST(line_no AS VARCHAR) || ': missing token value' AS message
FROM parsed WHERE tok = ''"""

ORACLE["stream_progress"] = _q("""
SELECT run_id, stage_index, CAST(COUNT(*) AS BIGINT) AS stage_count,
       CAST(COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS stage_successful,
       CAST(COUNT(*) - COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS stage_failed,
       MAX(target_rps) AS target_rps, MAX(active_users) AS active_users,
       round_even(AVG(latency_ms), 6) AS avg_latency_ms
FROM req WHERE stage_index IS NOT NULL GROUP BY run_id, stage_index""")

ORACLE["stream_stage_final"] = _q("""
SELECT s.run_id, s.stage_index, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(s.stage_index AS BIGINT) * 259200) AS window_start,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(s.stage_index + 1 AS BIGINT) * 259200) AS window_end,
       s.target_rps, s.active_users, CAST(COUNT(q.run_id) AS BIGINT) AS total_requests,
       CAST(COUNT(*) FILTER (WHERE q.status = 'success') AS BIGINT) AS successful,
       COALESCE(round_even(AVG(q.latency_ms), 6), CAST(0 AS DOUBLE)) AS avg_latency_ms
FROM sched s LEFT JOIN req q ON q.run_id = s.run_id AND q.stage_index = s.stage_index
GROUP BY s.run_id, s.stage_index, s.target_rps, s.active_users""")

ORACLE["stream_latest_snapshot"] = _q("""
SELECT run_id, arg_max(stage_index, (ts, event_id)) AS stage_index, MAX(ts) AS last_ts,
       arg_max(target_rps, (ts, event_id)) AS target_rps, arg_max(active_users, (ts, event_id)) AS active_users,
       CAST(COUNT(*) AS BIGINT) AS total_metrics
FROM req GROUP BY run_id""")

ORACLE["stage_report"] = _q("""
SELECT run_id, stage_index, elapsed_seconds, round_even(target_rps, 4) AS target_rps,
       round_even(achieved_rps, 4) AS achieved_rps, active_users, total_requests, successful, failed,
       avg_latency_ms, p50_latency_ms, p95_latency_ms, p99_latency_ms, error_rate
FROM sm""")

ORACLE["config_json"] = _c(f""",
descs AS (SELECT * FROM (VALUES {_DESC_VALUES}) t(suite_id, label, detail)),
ml AS (SELECT run_id, list({{'model': model, 'percentage': percentage}} ORDER BY model_pos) AS models
       FROM cfg_models GROUP BY run_id)
SELECT c.run_id, CAST(to_json({{
  'endpoint': {{'base_url': c.base_url, 'api_path': c.api_path}},
  'tokens': c.token_count,
  'rate': {{'unit': c.rate_unit, 'initial': c.initial_rate, 'max': c.max_rate,
            'scaling_factor': c.scaling_factor, 'time_increment': c.time_increment}},
  'users': {{'min': c.min_users, 'max': c.max_users, 'increment': c.users_increment}},
  'models': COALESCE(ml.models, []),
  'benchmark': {{'suite': c.benchmark_suite, 'description': COALESCE(d.label, 'Unknown')}},
  'timeout': c.timeout}}) AS VARCHAR) AS config_json
FROM cfg c LEFT JOIN ml ON ml.run_id = c.run_id LEFT JOIN descs d ON d.suite_id = c.benchmark_suite""")

ORACLE["stage_metrics_observed"] = _q(""",
el AS (
  SELECT run_id, stage_index,
         GREATEST(CAST(epoch_us(MAX(ts)) - epoch_us(MIN(ts)) AS DOUBLE) / CAST(1e6 AS DOUBLE),
                  CAST(0.001 AS DOUBLE)) AS el
  FROM req WHERE stage_index IS NOT NULL GROUP BY run_id, stage_index)
SELECT s.run_id, s.stage_index, COALESCE(e.el, s.duration) AS elapsed_seconds, s.target_rps,
       CASE WHEN COALESCE(a.n, 0) > 0
            THEN CAST(a.n AS DOUBLE) / GREATEST(COALESCE(e.el, s.duration), CAST(0.001 AS DOUBLE))
            ELSE CAST(0.0 AS DOUBLE) END AS achieved_rps,
       s.active_users, CAST(COALESCE(a.n, 0) AS BIGINT) AS total_requests,
       CAST(COALESCE(a.ok, 0) AS BIGINT) AS successful, CAST(COALESCE(a.n - a.ok, 0) AS BIGINT) AS failed,
       COALESCE(round_even(a.avg_l, 6), CAST(0.0 AS DOUBLE)) AS avg_latency_ms,
       COALESCE(a.p50, CAST(0.0 AS DOUBLE)) AS p50_latency_ms,
       COALESCE(a.p95, CAST(0.0 AS DOUBLE)) AS p95_latency_ms,
       COALESCE(a.p99, CAST(0.0 AS DOUBLE)) AS p99_latency_ms,
       CASE WHEN COALESCE(a.n, 0) > 0 THEN CAST(a.n - a.ok AS DOUBLE) / CAST(a.n AS DOUBLE)
            ELSE CAST(0.0 AS DOUBLE) END AS error_rate
FROM sched s LEFT JOIN agg a ON a.run_id = s.run_id AND a.stage_index = s.stage_index
LEFT JOIN el e ON e.run_id = s.run_id AND e.stage_index = s.stage_index""")


# Runs configured by customers, with their orders as requests.
ORDER_BASE = "WITH RECURSIVE " + CONFIG_BASE + f""",
gate AS (SELECT * FROM cfg WHERE initial_rate > 0 AND max_rate >= initial_rate AND scaling_factor >= 1.1 AND time_increment > 0),
ramp_o(run_id, stage_index, raw_rate) AS (
  SELECT run_id, 0, initial_rate FROM gate
  UNION ALL
  SELECT r.run_id, r.stage_index + 1, r.raw_rate * c.scaling_factor
  FROM ramp_o r JOIN gate c ON c.run_id = r.run_id
  WHERE r.raw_rate < c.max_rate AND r.raw_rate * c.scaling_factor > r.raw_rate),
sched AS (
  SELECT r.run_id, CAST(r.stage_index AS INTEGER) AS stage_index, LEAST(r.raw_rate, c.max_rate) AS target_rps,
         CAST(CASE WHEN NOT c.is_public AND c.token_count > 0
                   THEN LEAST(c.min_users + r.stage_index * c.users_increment, c.max_users, c.token_count)
                   ELSE LEAST(c.min_users + r.stage_index * c.users_increment, c.max_users) END AS INTEGER) AS active_users,
         c.time_increment AS duration, CAST(c.time_increment AS BIGINT) * 1000000 AS dur_us
  FROM ramp_o r JOIN gate c ON c.run_id = r.run_id),
spans AS (SELECT run_id, CAST(SUM(dur_us) AS BIGINT) AS span FROM sched GROUP BY run_id),
hit AS (
  SELECT p.run_id, o.o_orderkey AS k, (o.o_orderkey % 101) * p.span // 96 AS off_us, o.o_totalprice AS price
  FROM orders o JOIN spans p ON p.run_id = o.o_custkey),
req AS (
  SELECT h.run_id, row_number() OVER (PARTITION BY h.run_id ORDER BY h.off_us, h.k) AS seq, h.k AS event_id,
         s.stage_index, s.target_rps, s.active_users,
         CASE WHEN h.k % 14 = 1 THEN 'error' WHEN h.k % 7 = 1 THEN 'timeout' WHEN h.k % 7 = 0 THEN 'failure' ELSE 'success' END AS status,
         CASE WHEN h.k % 7 = 1 THEN CAST(0.0 AS DOUBLE) ELSE h.price END AS latency_ms
  FROM hit h LEFT JOIN sched s
    ON s.run_id = h.run_id AND h.off_us >= s.stage_index * s.dur_us AND h.off_us < (s.stage_index + 1) * s.dur_us),
""" + BASE[BASE.index("agg AS ("):]


def _o(tail: str) -> str:
    return ORDER_BASE + tail


ORACLE["order_requests"] = _o("SELECT run_id, seq, event_id, stage_index, target_rps, active_users, status, latency_ms FROM req")
ORACLE["order_stage_metrics"] = _o("SELECT * FROM sm")
ORACLE["order_scale_decision"] = _o(ORACLE["scale_decision"][len(BASE):])
_ACTIVE = """,
act AS (
  SELECT run_id, model, percentage, row_number() OVER (PARTITION BY run_id ORDER BY model_pos) - 1 AS pos,
         COUNT(*) OVER (PARTITION BY run_id) AS n
  FROM cfg_models m
  WHERE percentage > 0 OR (model_pos = 1 AND NOT EXISTS (SELECT 1 FROM cfg_models x WHERE x.run_id = m.run_id AND x.percentage > 0))),
rr AS (
  SELECT q.run_id, q.seq, a.model AS assigned_model, a.percentage AS assigned_percentage
  FROM req q LEFT JOIN act a ON a.run_id = q.run_id AND a.pos = q.seq % a.n)
"""
ORACLE["order_round_robin"] = _o(_ACTIVE + "SELECT * FROM rr")
ORACLE["order_duplicate"] = _o(_ACTIVE + """
SELECT q.run_id, q.seq, m.model AS assigned_model, m.percentage AS assigned_percentage
FROM req q JOIN cfg_models m ON m.run_id = q.run_id AND m.percentage = 100
UNION ALL
SELECT * FROM rr WHERE run_id NOT IN (SELECT run_id FROM cfg_models WHERE percentage = 100)""")
ORACLE["order_weighted"] = _o(""",
band AS (
  SELECT run_id, model, percentage, SUM(percentage) OVER (PARTITION BY run_id) AS cycle,
         SUM(percentage) OVER (PARTITION BY run_id ORDER BY model_pos) AS hi
  FROM cfg_models WHERE percentage > 0)
SELECT q.run_id, q.seq, b.model AS assigned_model, b.percentage AS assigned_percentage
FROM req q LEFT JOIN band b ON b.run_id = q.run_id AND q.seq % CAST(b.cycle AS BIGINT) < b.hi
  AND q.seq % CAST(b.cycle AS BIGINT) >= b.hi - b.percentage""")
ORACLE["order_credentials"] = _o(""",
pick AS (
  SELECT q.run_id, q.seq, c.token_count, CAST(CASE WHEN c.token_count > 0 THEN q.seq % c.token_count ELSE 0 END AS BIGINT) AS token_idx
  FROM req q JOIN cfg c ON c.run_id = q.run_id)
SELECT p.run_id, p.seq, p.token_idx,
       CASE WHEN p.token_count = 0 THEN 'public' ELSE COALESCE(NULLIF(t.label, ''), 'user-' || CAST(p.token_idx AS VARCHAR)) END AS assigned_label
FROM pick p LEFT JOIN cfg_tokens t ON t.run_id = p.run_id AND t.token_pos = p.token_idx + 1""")
ORACLE["order_run_status"] = _o(""",
plan AS (SELECT run_id, COUNT(*) AS planned, MAX(stage_index) AS last FROM sched GROUP BY run_id),
seen AS (SELECT run_id, COUNT(DISTINCT stage_index) AS observed, MAX(stage_index) AS last FROM req WHERE stage_index IS NOT NULL GROUP BY run_id)
SELECT p.run_id, CAST(p.planned AS BIGINT) AS planned_stages, CAST(COALESCE(s.observed, 0) AS BIGINT) AS observed_stages,
       CASE WHEN NOT c.is_public AND c.token_count = 0 THEN 'error' WHEN p.run_id % 13 = 0 THEN 'error' WHEN p.run_id % 13 = 1 THEN 'completed'
            WHEN s.last = p.last THEN 'completed' ELSE 'running' END AS run_status,
       CASE WHEN NOT c.is_public AND c.token_count = 0 THEN 'no credential configured for a private endpoint'
            WHEN p.run_id % 13 = 0 THEN 'Test cancelled' ELSE '' END AS error_message
FROM plan p JOIN cfg c ON c.run_id = p.run_id LEFT JOIN seen s ON s.run_id = p.run_id""")

ORACLE["bundle_stage_summary"] = ORACLE["stage_report"]
ORACLE["bundle_model_summary"] = ORACLE["model_summary"]
ORACLE["bundle_raw_requests"] = ORACLE["raw_report"]
ORACLE["bundle_errors"] = ORACLE["error_report"]
ORACLE["bundle_config"] = _q("""
SELECT run_id, CAST(i AS INTEGER) AS ordinal,
       ['base_url', 'api_path', 'rate_unit', 'initial_rate_rps', 'max_rate_rps', 'scaling_factor', 'time_increment_s', 'min_users',
        'max_users', 'users_increment', 'benchmark_suite', 'timeout_s', 'model_count', 'token_count'][i] AS key,
       ['http://inference.local/', '/v1/chat/completions', 'rps', '0.001000', '0.512000', '2.000000', '259200.000000', '1', '5', '1',
        'coding', '60.000000', '3', CAST(n_tokens AS VARCHAR)][i] AS value
FROM runs, range(1, 15) t(i)""")
# a file's text is stripped first: blank lines before the first other one don't count
ORACLE["credential_file_tokens"] = _CRED + """,
first AS (SELECT file, MIN(line_no) - 1 AS lead FROM body WHERE kind = 2 AND NOT (token = '' AND short) GROUP BY file)
SELECT CAST(p.file AS INTEGER) AS file, CAST(p.line_no - COALESCE(f.lead, 0) AS BIGINT) AS line_no, sha256(p.tok) AS token_sha256,
       CASE WHEN f.lead IS NULL THEN p.label ELSE 'token-' || CAST(p.line_no - f.lead AS VARCHAR) END AS label
FROM parsed p LEFT JOIN first f ON f.file = p.file WHERE p.tok <> ''"""
ORACLE["rate_texts"] = _c("""
SELECT run_id, initial_rate AS initial_rps,
       CAST(round_even(CASE WHEN rate_unit = 'rpm' THEN initial_rate * CAST(60.0 AS DOUBLE) ELSE initial_rate END, 0) AS INTEGER) AS initial_shown,
       CASE WHEN rate_unit = 'rpm' THEN printf('%d RPM = %.2f RPS', CAST(initial_display AS BIGINT), round_even(initial_display / CAST(60.0 AS DOUBLE), 2))
            ELSE printf('%d RPS = %.2f RPS', CAST(initial_display AS BIGINT), round_even(initial_display, 2)) END AS conversion,
       rtrim(base_url, '/') || '/' || ltrim(api_path, '/') AS endpoint_view
FROM cfg""")
ORACLE["stored_run_summary"] = ORACLE["run_summary"]

ORACLE["incremental_rollup"] = ORACLE["multi_grain_rollup"]
ORACLE["sketched_percentiles"] = _q("""
SELECT run_id, CAST(COUNT(*) AS BIGINT) AS n, TRUE AS p50_within, TRUE AS p95_within, TRUE AS p99_within FROM req GROUP BY run_id""")
ORACLE["bundle_rate_series"] = ORACLE["rate_series"]

ORACLE["suite_coverage_segments"] = _CAT + """,
own AS (SELECT DISTINCT 'segment-' || lower(c_mktsegment) AS suite_id, length(c_mktsegment) % 2 = 0 AS told FROM customer),
dim AS (SELECT suite_id FROM suites UNION ALL SELECT suite_id FROM own),
descs AS (SELECT suite_id FROM suites UNION ALL SELECT suite_id FROM own WHERE told UNION ALL SELECT 'nation-' || lower(n_name) FROM nation)
SELECT suite_id, 'no_prompts' AS issue FROM dim WHERE suite_id NOT IN (SELECT suite_id FROM prompts)
UNION ALL SELECT suite_id, 'no_description' FROM dim WHERE suite_id NOT IN (SELECT suite_id FROM descs)
UNION ALL SELECT suite_id, 'not_a_suite' FROM descs WHERE suite_id NOT IN (SELECT suite_id FROM dim)"""
ORACLE["suite_prompts"] = _CAT + """
SELECT suite_id, CAST(row_number() OVER (ORDER BY prompt_index) - 1 AS BIGINT) AS prompt_index, text FROM prompts WHERE suite_id = 'coding'"""
_WIDE = CONFIG_BASE.replace("CAST(c % 4 AS INTEGER) AS model_count", "CAST(c % 13 AS INTEGER) AS model_count").replace(
    "CAST(60.0 AS DOUBLE) AS timeout", "CAST(c % 700 AS DOUBLE) AS timeout, CAST(c * 7 % 13000 AS INTEGER) AS num_rows").replace(
    "CAST(CASE WHEN (run_id + i) % 17 = 0 THEN 150.0 WHEN", "CAST(CASE WHEN true THEN 50.0 WHEN")
ORACLE["config_range_audit_wide"] = "WITH RECURSIVE " + _WIDE + _RANGES + """
SELECT * FROM ranges
UNION ALL SELECT run_id, 'rows_range', CAST(num_rows AS VARCHAR) FROM cfg WHERE NOT (num_rows BETWEEN 10 AND 10000)"""
ORACLE["live_progress"] = _q(""",
c AS (
  SELECT run_id, stage_index, CAST(COUNT(*) AS BIGINT) AS stage_count, CAST(COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS stage_successful,
         CAST(COUNT(*) - COUNT(*) FILTER (WHERE status = 'success') AS BIGINT) AS stage_failed,
         MAX(target_rps) AS target_rps, MAX(active_users) AS active_users, MAX(ts) AS last_ts
  FROM req WHERE stage_index IS NOT NULL GROUP BY run_id, stage_index)
SELECT *, last_ts = MAX(last_ts) OVER (PARTITION BY run_id) AS shown FROM c""")
