"""Aggregations.

Every latency profile (counts, mean and floor-rank percentiles) is computed
from one per-(group, latency) histogram: a single shuffle of the request log,
combined map-side; totals, successes, the mean and the percentiles all come
from that much smaller table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampstat.operators.percentiles import PCTS, disc_or_approx, percentile_aggs
from rampstat.operators.joins import broadcast_if_small
from rampstat.operators.ranking import running_sums
from rampstat.functions.rates import report_round
from rampstat.schema import MIN_ELAPSED_S

AVG_DIGITS = 6
PCT_COLS = ["p50_latency_ms", "p95_latency_ms", "p99_latency_ms"]


def _profile_select(group_cols):
    return [*group_cols,
            F.col("total_requests").cast("long").alias("total_requests"),
            F.col("successful").cast("long").alias("successful"),
            (F.col("total_requests") - F.col("successful")).cast("long").alias("failed"),
            report_round(F.col("_sum") / F.col("total_requests"), AVG_DIGITS).alias("avg_latency_ms"),
            *PCT_COLS]


def profile_from_histogram(hist: DataFrame, group_cols: list[str],
                           value_col: str = "latency_ms") -> DataFrame:
    """Counts, successes, mean and floor-rank percentiles per group from a
    (group, value, c, _ok) histogram - one running-count pass, one group-by."""
    cum = running_sums(hist, group_cols, [value_col], {"_cum": "c"}, with_totals=True)
    prof = cum.groupBy(*group_cols).agg(
        F.sum("c").alias("total_requests"), F.sum("_ok").alias("successful"),
        F.sum(F.col(value_col) * F.col("c")).alias("_sum"),
        *percentile_aggs(PCTS, PCT_COLS, value_col))
    return prof.select(*_profile_select(group_cols))


def latency_profile(requests: DataFrame, group_cols: list[str], method: str = "histogram",
                    value_col: str = "latency_ms", success_only: bool = False) -> DataFrame:
    """Per group: total_requests, successful, failed, avg_latency_ms (rounded
    to 6 digits), p50/p95/p99 (floor rank). Failed = every non-success.
    ``success_only``: mean and percentiles are of the successful requests
    (0.0 where there are none); by default those of all, failures as 0.0."""
    ok = (F.col("status") == "success").cast("long")
    if success_only:
        counts = requests.groupBy(*group_cols).agg(F.count("*").alias("n_all"), F.sum(ok).alias("n_ok"))
        good = latency_profile(requests.where(F.col("status") == "success"), group_cols, method, value_col)
        on = [counts[c].eqNullSafe(good[c]) for c in group_cols]
        return counts.join(good, on, "left").select(
            *[counts[c] for c in group_cols], F.col("n_all").cast("long").alias("total_requests"), F.col("n_ok").cast("long").alias("successful"),
            (F.col("n_all") - F.col("n_ok")).cast("long").alias("failed"),
            *[F.coalesce(good[c], F.lit(0.0)).alias(c) for c in ["avg_latency_ms", *PCT_COLS]])
    if method == "histogram":
        hist = requests.groupBy(*group_cols, value_col).agg(
            F.count("*").alias("c"), F.sum(ok).alias("_ok"))
        return profile_from_histogram(hist, group_cols, value_col)
    prof = requests.groupBy(*group_cols).agg(
        F.count("*").alias("total_requests"), F.sum(ok).alias("successful"),
        F.sum(value_col).alias("_sum"),
        *[disc_or_approx(value_col, p, method).alias(n) for p, n in zip(PCTS, PCT_COLS)])
    return prof.select(*_profile_select(group_cols))


def stage_metrics(requests: DataFrame, schedule: DataFrame, run_col: str = "run_id",
                  method: str = "histogram", elapsed: DataFrame | None = None,
                  success_only: bool = False) -> DataFrame:
    """E1 + D2: one row per planned stage. Stages without requests give
    zeros but keep target rate and users. Elapsed = the planned stage
    duration (E5), or ``elapsed`` (run_id, stage_index, elapsed_seconds)."""
    prof = latency_profile(requests.where(F.col("stage_index").isNotNull()),
                           [run_col, "stage_index"], method, success_only=success_only)
    sch = schedule.select(run_col, "stage_index", "target_rps", "active_users",
                          F.col("duration").alias("elapsed_seconds"))
    if elapsed is not None:
        # stages without requests keep their planned duration
        sch = (sch.withColumnRenamed("elapsed_seconds", "_planned")
               .join(elapsed, [run_col, "stage_index"], "left")
               .withColumn("elapsed_seconds", F.coalesce("elapsed_seconds", "_planned")).drop("_planned"))
    j = sch.join(prof, [run_col, "stage_index"], "left")
    n = F.coalesce(F.col("total_requests"), F.lit(0)).cast("long")
    el = F.greatest(F.col("elapsed_seconds").cast("double"), F.lit(MIN_ELAPSED_S))
    failed = F.coalesce(F.col("failed"), F.lit(0)).cast("long")
    return j.select(
        run_col, F.col("stage_index").cast("int").alias("stage_index"),
        F.col("elapsed_seconds").cast("double").alias("elapsed_seconds"),
        "target_rps",
        F.when(n > 0, n / el).otherwise(F.lit(0.0)).alias("achieved_rps"),
        F.col("active_users").cast("int").alias("active_users"),
        n.alias("total_requests"),
        F.coalesce(F.col("successful"), F.lit(0)).cast("long").alias("successful"),
        failed.alias("failed"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ["avg_latency_ms", *PCT_COLS]],
        F.when(n > 0, failed / n).otherwise(F.lit(0.0)).alias("error_rate"),
    )


def observed_elapsed(requests: DataFrame, run_col: str = "run_id") -> DataFrame:
    """E5 option: a stage's elapsed seconds measured from its own requests
    (last minus first timestamp, floored at 1 ms) instead of the plan."""
    return requests.where(F.col("stage_index").isNotNull()).groupBy(run_col, "stage_index").agg(
        F.expr("greatest(CAST(unix_micros(max(ts)) - unix_micros(min(ts)) AS DOUBLE) / 1e6D, 0.001D)")
        .alias("elapsed_seconds"))


def model_summary(requests: DataFrame, run_col: str = "run_id", method: str = "histogram",
                  order_cols: tuple[str, ...] = ("ts", "event_id"), use_seq: bool = False) -> DataFrame:
    """E3 + G4: per (run, model) totals, success rate, mean and percentiles,
    with ``first_seq`` - the run sequence number of the model's first request
    (models are listed in first-seen order).

    Without a ``seq`` column, ``first_seq`` = 1 + requests of the run before
    the model's first one: each request is placed among the sorted first keys of
    its run's models (one array per run, joined once), the places are counted,
    and the counts of earlier places add up. No request is multiplied and no
    global numbering is needed."""
    prof = latency_profile(requests, [run_col, "model"], method)
    if use_seq:
        first = requests.groupBy(run_col, "model").agg(F.min("seq").cast("long").alias("first_seq"))
    else:
        key = F.struct(*order_cols)
        firsts = requests.groupBy(run_col, "model").agg(F.min(key).alias("k"))
        per_run = broadcast_if_small(firsts.groupBy(run_col).agg(
            F.array_sort(F.collect_list(F.struct("k", "model"))).alias("_firsts")))
        placed = requests.select(run_col, key.alias("_k")).join(per_run.select(run_col, F.col("_firsts.k").alias("_ks")), run_col)
        counts = placed.select(run_col, F.expr("size(filter(_ks, k -> k <= _k))").alias("_place")).groupBy(run_col, "_place").agg(
            F.count("*").alias("_c"))
        w = Window.partitionBy(run_col).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # a row per model
        starts = counts.select(run_col, "_place", (F.coalesce(F.sum("_c").over(w), F.lit(0)) + 1).cast("long").alias("first_seq"))
        models = per_run.select(run_col, F.posexplode("_firsts").alias("_pos", "_f")).select(
            run_col, (F.col("_pos") + 1).alias("_place"), F.col("_f.model").alias("model"))
        first = models.join(starts, [run_col, "_place"]).select(run_col, "model", "first_seq")
    j = prof.join(first, [run_col, "model"])
    return j.select(run_col, "model", "first_seq", "total_requests", "successful", "failed",
                    F.when(F.col("total_requests") > 0,
                           F.col("successful") / F.col("total_requests")).otherwise(F.lit(0.0))
                    .alias("success_rate"),
                    "avg_latency_ms", *PCT_COLS)


def run_summary(requests: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Summary cards per run."""
    ok = (F.col("status") == "success").cast("long")
    return requests.groupBy(run_col).agg(
        F.count("*").cast("long").alias("total_requests"),
        F.sum(ok).cast("long").alias("successful"),
        (F.count("*") - F.sum(ok)).cast("long").alias("failed"),
        F.coalesce(report_round(F.avg("latency_ms"), AVG_DIGITS), F.lit(0.0)).alias("avg_latency_ms"))


#: ``grouping_id`` of (run, stage, model, latency) in each grain's grouping set.
GRAINS = {6: "run", 2: "stage", 4: "model"}


def rollup_histogram(hist: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A (run, stage, model, latency) histogram's counts by run, by (run, stage) and by
    (run, model), told apart by ``grain``: its rows, not the requests, are expanded."""
    cols = [run_col, "stage_index", "model", "latency_ms"]
    sets = hist.groupingSets([[run_col, "latency_ms"], [run_col, "stage_index", "latency_ms"], [run_col, "model", "latency_ms"]], *cols).agg(
        F.grouping_id().alias("_set"), F.sum("c").alias("c"), F.sum("_ok").alias("_ok"))
    # the grain is part of the key: a null stage or model is a group of its own, not a total
    grain = F.lit(None).cast("string")
    for number, name in GRAINS.items():
        grain = F.when(F.col("_set") == number, F.lit(name)).otherwise(grain)
    return sets.select(grain.alias("grain"), *cols, "c", "_ok")


def multi_grain_rollup(requests: DataFrame, run_col: str = "run_id") -> DataFrame:
    """(run), (run, stage) and (run, model) profiles in one pass - the
    GROUPING SETS of the three report loops. One scan gives a histogram over
    (run, stage, model, latency) that is expanded to the three grains, and one running
    count over all of them picks the percentiles."""
    ok = (F.col("status") == "success").cast("long")
    base = requests.groupBy(run_col, "stage_index", "model", "latency_ms").agg(F.count("*").alias("c"), F.sum(ok).alias("_ok"))
    return profile_from_histogram(rollup_histogram(base, run_col), ["grain", run_col, "stage_index", "model"], "latency_ms")


def scale_info(stages: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per run the target peak (RPM), its first stage, achieved peak,
    and the y-axis decision: achieved peak <= 0 -> off-scale iff target > 0,
    y = 1; else off-scale iff target/achieved > 10 (strict), y = max(1,
    1.15 * achieved) when off-scale, else the larger peak."""
    rpm_t = F.col("target_rps") * F.lit(60.0)
    rpm_a = F.col("achieved_rps") * F.lit(60.0)
    peaks = stages.groupBy(run_col).agg(
        F.max(rpm_t).alias("target_max"),
        F.min_by(F.col("stage_index"), F.struct(-rpm_t, F.col("stage_index"))).alias("target_peak_stage"),
        F.max(rpm_a).alias("achieved_max"))
    t, a = F.col("target_max"), F.col("achieved_max")
    use = F.when(a <= 0, t > 0).otherwise(t / a > 10.0)
    y = F.when(a <= 0, F.lit(1.0)).when(t / a > 10.0, F.greatest(F.lit(1.0), a * F.lit(1.15))) \
        .otherwise(F.greatest(t, a))
    return peaks.select(run_col, "target_max", F.col("target_peak_stage").cast("int")
                        .alias("target_peak_stage"), "achieved_max",
                        use.alias("use_achieved_scale"), y.alias("y_max"))
