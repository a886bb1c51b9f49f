"""Running progress after every request (F1-F4, F6, B16-B20, B22) and the
latest snapshot of a run (J2, J3) - batch forms.

Running counters use ``running_sums`` (range-partitioned), never a window
over a whole stage or run; run-wide totals add the request counts of the
earlier stages (a window over the per-stage count table, bounded by the
number of stages).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampstat.functions.rates import (
    at_least_elapsed, planned_interval_s, progress_fraction, rate_delta, stage_number,
)
from rampstat.operators.joins import broadcast_if_small
from rampstat.operators.ranking import previous_in_group, running_sums

US_PER_S = 1000000.0


def _us():
    return F.lit(US_PER_S)


def _stage_start_us(run_start_ts, t0_offset_s):
    return F.unix_micros(run_start_ts) + (t0_offset_s * _us()).cast("long")


def running_progress(requests: DataFrame, schedule: DataFrame, runs: DataFrame,
                     run_col: str = "run_id", order_cols=("ts", "event_id"),
                     placeholder: bool = True) -> DataFrame:
    """Per request, the stage's running count / successes / failures,
    the run's running total, the stage's elapsed seconds and achieved rate,
    run elapsed ms (F4 + B18), progress fraction (B19) and rate delta (B20).
    ``placeholder`` adds the all-zero row each run starts with (seq 0)."""
    # only the columns progress needs travel through the running-sum pass
    r = requests.where(F.col("stage_index").isNotNull()).select(
        run_col, "stage_index", *order_cols, "target_rps", "active_users",
        (F.col("status") == "success").cast("long").alias("_ok"))
    rs = running_sums(r, [run_col, "stage_index"], list(order_cols),
                      {"stage_count": F.lit(1), "stage_successful": "_ok"})
    per_stage = r.groupBy(run_col, "stage_index").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(run_col).orderBy("stage_index").rowsBetween(Window.unboundedPreceding, -1)
    prev = per_stage.select(run_col, "stage_index",
                            F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_prev"))
    total = schedule.groupBy(run_col).agg(F.count("*").alias("total_stages"))
    sch = schedule.select(run_col, "stage_index", "t0_offset_s", "duration")
    starts = runs.select(run_col, "started_at")
    # one row per (run, stage): broadcast after a count proves it small
    stage_info = broadcast_if_small(
        prev.join(sch, [run_col, "stage_index"], "left").join(total, run_col, "left")
        .join(starts, run_col, "left"))
    j = rs.join(stage_info, [run_col, "stage_index"], "left")
    st_us = _stage_start_us(F.col("started_at"), F.col("t0_offset_s"))
    elapsed = ((F.unix_micros(F.col("ts")) - st_us).cast("double") / _us())
    j = j.withColumn("stage_elapsed_s", elapsed)
    achieved = F.col("stage_count") / at_least_elapsed(F.col("stage_elapsed_s"))
    out = j.select(
        run_col,
        (F.col("_prev") + F.col("stage_count")).cast("long").alias("seq"),
        F.col("stage_index").cast("int").alias("stage_index"),
        stage_number().cast("int").alias("stage_number"),
        F.col("stage_count").cast("long").alias("stage_count"),
        F.col("stage_successful").cast("long").alias("stage_successful"),
        (F.col("stage_count") - F.col("stage_successful")).cast("long").alias("stage_failed"),
        (F.col("_prev") + F.col("stage_count")).cast("long").alias("total_metrics"),
        "target_rps", F.col("active_users").cast("int").alias("active_users"),
        "stage_elapsed_s",
        achieved.alias("achieved_rps"),
        ((F.col("t0_offset_s") + F.col("stage_elapsed_s")) * F.lit(1000.0)).alias("elapsed_ms"),
        progress_fraction(F.col("stage_index"), F.col("stage_elapsed_s"), F.col("duration"),
                          F.col("total_stages")).alias("progress_fraction"),
        rate_delta(achieved, F.col("target_rps")).alias("rate_delta"),
    )
    if not placeholder:
        return out
    first = schedule.where(F.col("stage_index") == 0).select(
        run_col, F.lit(0).cast("long").alias("seq"), F.lit(0).alias("stage_index"),
        F.lit(1).alias("stage_number"), F.lit(0).cast("long").alias("stage_count"),
        F.lit(0).cast("long").alias("stage_successful"), F.lit(0).cast("long").alias("stage_failed"),
        F.lit(0).cast("long").alias("total_metrics"), "target_rps",
        F.col("active_users").cast("int").alias("active_users"),
        F.lit(0.0).alias("stage_elapsed_s"), F.lit(0.0).alias("achieved_rps"),
        F.lit(0.0).alias("elapsed_ms"), F.lit(0.0).alias("progress_fraction"),
        (F.lit(0.0) - F.col("target_rps")).alias("rate_delta"))
    # placeholder only for runs that appear in the log
    seen = r.select(run_col).distinct()
    return out.unionByName(first.join(seen, run_col, "left_semi"))


def pacing_gaps(requests: DataFrame, run_col: str = "run_id", order_cols=("ts", "event_id")) -> DataFrame:
    """gap to the previous request of the same stage vs the planned
    interval (B16); slack <= 0 means the run fell behind its target rate.
    The previous request comes from the same range-partitioned pass over the log
    (``previous_in_group``): one shuffle, no join of the log with itself."""
    r = requests.where(F.col("stage_index").isNotNull()).select(
        run_col, "seq", "stage_index", "target_rps", *order_cols)
    j = previous_in_group(r, [run_col, "stage_index"], list(order_cols), "ts", "_prev_ts")
    gap = (F.unix_micros(F.col("ts")) - F.unix_micros(F.col("_prev_ts"))).cast("double") / _us()
    planned = planned_interval_s(F.col("target_rps"))
    return j.select(run_col, "seq", "stage_index", gap.alias("gap_s"),
                    planned.alias("planned_interval_s"), (planned - gap).alias("slack_s"))


def latest_snapshot(requests: DataFrame, as_of: str, run_col: str = "run_id",
                    order_cols=("ts", "event_id")) -> DataFrame:
    """J2/J3 (batch): the last progress state of each run - last write wins
    (``max_by`` over the arrival order, a partial aggregate) - and its age in
    seconds at ``as_of``."""
    key = F.struct(*order_cols)
    last = requests.groupBy(run_col).agg(
        F.max_by(F.struct("stage_index", "ts", "target_rps", "active_users"), key).alias("_l"),
        F.count("*").cast("long").alias("total_metrics"))
    ok = (F.col("status") == "success").cast("long")
    st = requests.groupBy(run_col, "stage_index").agg(
        F.count("*").cast("long").alias("stage_count"), F.sum(ok).cast("long").alias("stage_successful"))
    l2 = last.select(run_col, "total_metrics", F.col("_l.stage_index").alias("stage_index"),
                     F.col("_l.ts").alias("last_ts"), F.col("_l.target_rps").alias("target_rps"),
                     F.col("_l.active_users").alias("active_users"))
    j = l2.join(st, [run_col, "stage_index"], "left")
    age = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col("last_ts"))).cast("double") / _us()
    return j.select(run_col, "stage_index", "total_metrics", "stage_count", "stage_successful",
                    (F.col("stage_count") - F.col("stage_successful")).alias("stage_failed"),
                    "target_rps", "active_users", "last_ts", age.alias("age_s"))
