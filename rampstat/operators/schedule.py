"""Ramp schedule per run configuration.

The stage rates come from an array fold, not ``initial * factor ** k``: the
fold multiplies exactly like the loop it mirrors, so rates agree bit for bit.
It goes block by block: within a block of ``BLOCK`` stages rates are appended one by one,
then the whole block is, and its last rate is carried to the next, so the copying of
arrays grows with the number of stages (and blocks), not with its square.
The fold length is an upper bound on the number of stages; the stop test
(next rate no longer below the cap, or not growing) leaves the surplus
iterations idle. Each configuration is one row, so the work is spread over
runs; a run's stage list is its own output size. ``schedulable`` keeps the configurations
that the rate and range rules accept (C7, C9): at most some 80 stages each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampstat.operators.quality import range_checks, rate_rules

#: Stages that are appended one by one before a block is.
BLOCK = 64

_BOUND_SQL = ("CASE WHEN scaling_factor > 1.0D AND initial_rate > 0.0D AND initial_rate < max_rate "
              "THEN CAST(ceil(ln(max_rate / initial_rate) / ln(scaling_factor)) + 2 AS INT) ELSE 1 END")
# one block: the carried rate, then the uncapped rate of every stage; append while the last
# stage is below the cap and multiplying still grows the rate
_BLOCK_SQL = (f"aggregate(sequence(1, {BLOCK}), array(acc.last), (a, j) -> "
              "CASE WHEN element_at(a, -1) < max_rate AND element_at(a, -1) * scaling_factor > element_at(a, -1) "
              "THEN concat(a, array(element_at(a, -1) * scaling_factor)) ELSE a END)")
_FOLD_SQL = (f"slice(flatten(aggregate(sequence(1, ({_BOUND_SQL}) div {BLOCK} + 1), "
             "named_struct('last', initial_rate, 'blocks', array(array(initial_rate))), "
             f"(acc, i) -> element_at(transform(array({_BLOCK_SQL}), b -> named_struct("
             "'last', element_at(b, -1), 'blocks', IF(size(b) > 1, concat(acc.blocks, array(slice(b, 2, size(b) - 1))), acc.blocks))), 1), "
             f"acc -> acc.blocks)), 1, {_BOUND_SQL})")


def schedulable(configs: DataFrame) -> DataFrame:
    """The configurations that break no rate rule (C7) and lie within the allowed ranges (C9):
    only those get a schedule. A filter on each row; needs the columns of both."""
    return configs.where((F.size(rate_rules()) == 0) & (F.size(range_checks(configs.columns)) == 0))


def build_schedule(configs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """One row per stage: (run_id, stage_index, target_rps, active_users,
    duration, t0_offset_s, t1_offset_s). Expects the configuration columns
    ``initial_rate, max_rate, min_users, max_users, users_increment,
    scaling_factor, time_increment`` (rates in canonical RPS)."""
    staged = configs.selectExpr(
        run_col, "min_users", "max_users", "users_increment", "max_rate", "time_increment",
        f"posexplode({_FOLD_SQL}) AS (stage_index, raw_rate)")
    return staged.selectExpr(
        run_col,
        "CAST(stage_index AS INT) AS stage_index",
        "least(raw_rate, max_rate) AS target_rps",
        "CAST(least(min_users + stage_index * users_increment, max_users) AS INT) AS active_users",
        "time_increment AS duration",
        # seconds of earlier stages (durations are constant within a run)
        "CAST(stage_index AS DOUBLE) * time_increment AS t0_offset_s",
        "CAST(stage_index + 1 AS DOUBLE) * time_increment AS t1_offset_s",
    )


def stage_counts(schedule: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Number of stages per run."""
    return schedule.groupBy(run_col).agg(F.count("*").cast("long").alias("total_stages"))


def schedule_offsets(schedule: DataFrame, run_col: str = "run_id") -> DataFrame:
    """F4 for arbitrary (not necessarily constant) durations: start offset of
    each stage = sum of earlier durations. A run's stages are few, so the
    window per run is bounded by its stage count."""
    from pyspark.sql import Window
    w = Window.partitionBy(run_col).orderBy("stage_index").rowsBetween(Window.unboundedPreceding, -1)
    return schedule.select(
        run_col, "stage_index", "duration",
        F.coalesce(F.sum("duration").over(w), F.lit(0.0)).alias("t0_offset_s"),
    ).withColumn("t1_offset_s", F.col("t0_offset_s") + F.col("duration"))

