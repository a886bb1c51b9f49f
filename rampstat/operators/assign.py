"""Assigning requests to stages, models, credentials and prompts (D3-D6,
D9-D11, C4, F5).

Request -> stage is a range condition (``t0 <= ts < t1``). A plain range join
plans as a nested loop, so the request joins its run - an equi-join - and is looked up
by binary search among the run's sorted stage boundaries. All times
are whole microseconds.

Round-robin picks (model, credential, prompt) are ``list[seq % n]`` with the
1-based request sequence number: the first request of a run takes element 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampstat.functions.rates import allocated_rps
from rampstat.operators.joins import broadcast_if_small
from rampstat.operators.ranking import row_number_in_group


def run_slots(schedule: DataFrame, runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """One row per run: ``_t_start``, its start, ``_from``, the sorted offsets at which its stages
    begin, ``_held``, the stages in that order with their ends, and ``_turns``, the halvings a
    search takes. Times are whole microseconds, so a request exactly at a boundary falls into the
    stage that begins there. Of overlapping stages the earliest one counts: a stage that begins while an
    earlier one lasts begins for the search when that one ends. Size: an entry per stage,
    whatever the request volume and the stages' lengths."""
    s = schedule.selectExpr(run_col, "stage_index", "target_rps", "active_users",
                            "CAST(round(t0_offset_s * 1e6D) AS BIGINT) AS t0", "CAST(round(t1_offset_s * 1e6D) AS BIGINT) AS t1"
                            ).where("t1 > t0")
    # a run's plan, not its log
    w = Window.partitionBy(run_col).orderBy("t0", "t1", "stage_index").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_before", F.max("t1").over(w)).withColumn("_begin", F.expr("greatest(t0, _before)")).where("_begin < t1")
    slots = s.groupBy(run_col).agg(F.expr(
        "array_sort(collect_list(struct(_begin, t1, stage_index, target_rps, active_users)))").alias("_held"))
    slots = slots.selectExpr(run_col, "transform(_held, s -> s._begin) AS _from", "_held",
                             "sequence(1, CAST(ceil(log2(size(_held))) AS INT) + 1) AS _turns")
    starts = runs.selectExpr(run_col, "unix_micros(started_at) AS _t_start")
    return slots.join(starts, run_col)


# halves [lo, hi) until one place is left: the last stage that begins at or before the offset
_SEARCH_SQL = ("aggregate(_turns, named_struct('lo', 0, 'hi', size(_from)), (a, i) -> IF(a.hi - a.lo <= 1, a, "
               "IF(get(_from, (a.lo + a.hi) div 2) <= _off, named_struct('lo', CAST((a.lo + a.hi) div 2 AS INT), 'hi', a.hi), "
               "named_struct('lo', a.lo, 'hi', CAST((a.lo + a.hi) div 2 AS INT)))), a -> a.lo)")


def assign_stage(requests: DataFrame, schedule: DataFrame, runs: DataFrame,
                 run_col: str = "run_id", ts_col: str = "ts") -> DataFrame:
    """D3: attach ``stage_index, active_users, target_rps`` of the stage whose
    slot ``[t0, t1)`` holds each request. ``schedule`` has ``t0_offset_s,
    t1_offset_s`` relative to the run's ``started_at`` (from ``runs``).

    A single equi-join on the run against ``run_slots`` (one row per run,
    broadcast when its measured size is small - a dominant run then never
    concentrates in one shuffle partition), then a binary search among the run's
    stages: as many steps as the logarithm of their number, however unequal
    their lengths. Requests outside every slot keep null stage columns; of overlapping
    stages the earliest one counts."""
    rs = broadcast_if_small(run_slots(schedule, runs, run_col))
    j = requests.join(rs, run_col, "left")
    j = j.withColumn("_off", F.expr(f"unix_micros({ts_col}) - _t_start"))
    j = j.withColumn("_k", F.expr(f"CASE WHEN _off >= get(_from, 0) THEN get(_held, {_SEARCH_SQL}) END"))
    held = lambda c: F.expr(f"IF(_off < _k.t1, _k.{c}, NULL)")
    return j.select(*[F.col(f"`{c}`") for c in requests.columns], held("stage_index").cast("int").alias("stage_index"),
                    held("target_rps").alias("target_rps"), held("active_users").cast("int").alias("active_users"))


def cap_users(schedule: DataFrame, runs: DataFrame, tokens: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A private run with credentials has no more users at a time than those.
    ``runs`` has ``is_public``; ``tokens`` one row per run and credential."""
    n = tokens.groupBy(run_col).agg(F.count("*").alias("_n"))
    limits = runs.where(~F.col("is_public")).select(run_col).join(n, run_col)
    j = schedule.join(limits, run_col, "left")
    users = F.least(F.col("active_users"), F.col("_n")).cast("int")  # no credentials: null, which least() skips
    return j.select(*[users.alias(c) if c == "active_users" else F.col(c) for c in schedule.columns])


def with_sequence(requests: DataFrame, run_col: str = "run_id",
                  order_cols: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """1-based request number within the run in arrival order."""
    return row_number_in_group(requests, [run_col], list(order_cols), name="seq")


def active_models(models_col: str = "models"):
    """C4: models with percentage > 0; if none, the first configured model."""
    act = F.filter(F.col(models_col), lambda m: m["percentage"] > 0)
    return F.when(F.size(act) == 0, F.slice(F.col(models_col), 1, 1)).otherwise(act)


def assign_round_robin(requests: DataFrame, runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """model = active[seq % n_active]."""
    rm = broadcast_if_small(runs.select(run_col, active_models().alias("_active")))
    j = requests.join(rm, run_col, "left")
    n = F.size("_active")
    pick = F.when(n > 0, F.element_at("_active", (F.pmod(F.col("seq"), n) + 1).cast("int")))
    return j.select(*requests.columns, pick["model"].alias("assigned_model"),
                    pick["percentage"].alias("assigned_percentage"))


#: Decimals of a share that count; finer shares get one unit of this size.
SHARE_DECIMALS = 6

_GCD_SQL = ("aggregate(sequence(1, 64), named_struct('a', s, 'b', _cycle), (g, i) -> IF(g.b = 0L, g, "
            "named_struct('a', g.b, 'b', g.a % g.b)), g -> g.a)")


def weighted_bands(runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """One row per run: ``_bands``, the models with a share and where their
    bands of the cycle end, ``_cycle``, its length, and ``_step``, by which requests walk
    around it. Whole percentages give a cycle as long as their sum (100 for a full split) that
    is walked in order; fractions a unit as fine as the finest share needs, so each
    share has its exact part of a cycle and none is empty. Such a cycle is long, so it is
    walked in steps of about 0.618 of its length (with no common divisor, so
    that each place is met once): every stretch of requests then has its shares, nearly."""
    active = "filter(models, m -> m.percentage > 0)"
    whole = "abs(m.percentage * power(10D, d) - rint(m.percentage * power(10D, d))) < 1e-6D"
    unit = f"power(10D, coalesce(get(filter(sequence(0, {SHARE_DECIMALS}), d -> forall(_active, m -> {whole})), 0), {SHARE_DECIMALS}))"
    ends = ("aggregate(_active, CAST(array() AS array<struct<hi: bigint, model: string, percentage: double>>), (acc, m) -> concat(acc, array("
            "named_struct('hi', coalesce(try_element_at(acc, -1).hi, 0L) + greatest(CAST(round(m.percentage * _unit) AS BIGINT), 1L), "
            "'model', m.model, 'percentage', m.percentage))))")
    step = (f"CASE WHEN _unit > 1D THEN get(filter(transform(sequence(0, 200), k -> CAST(_cycle * 0.6180339887D AS BIGINT) + k), s -> {_GCD_SQL} = 1L), 0) "
            "ELSE 1L END")
    return (runs.selectExpr(run_col, f"{active} AS _active").selectExpr(run_col, "_active", f"{unit} AS _unit")
            .selectExpr(run_col, "_unit", f"{ends} AS _bands").selectExpr(run_col, "_unit", "_bands", "try_element_at(_bands, -1).hi AS _cycle")
            .selectExpr(run_col, "_bands", "_cycle", f"coalesce({step}, 1L) AS _step"))


def assign_weighted(requests: DataFrame, runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Weighted split by the request's place in the run's cycle, looked up in its bands; a
    run without any share leaves the model null."""
    j = requests.join(broadcast_if_small(weighted_bands(runs, run_col)), run_col, "left")
    pick = F.expr("get(filter(_bands, b -> pmod(pmod(seq, _cycle) * _step, _cycle) < b.hi), 0)")
    return j.select(*requests.columns, pick.alias("_p")).select(
        *requests.columns, F.col("_p.model").alias("assigned_model"), F.col("_p.percentage").alias("assigned_percentage"))


def assign_duplicate(requests: DataFrame, runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Every request goes to each model at 100 %; runs without such a
    model fall back to the round-robin pick. One join of the log to one row per run."""
    per_run = broadcast_if_small(runs.select(
        run_col, F.filter("models", lambda m: m["percentage"] == 100).alias("_full"), active_models().alias("_active")))
    j = requests.join(per_run, run_col, "left")
    one = F.array(F.expr("get(_active, CAST(pmod(seq, size(_active)) AS INT))"))
    picks = F.when(F.size("_full") > 0, F.col("_full")).when(F.size("_active") > 0, one)
    return j.select(*requests.columns, F.explode_outer(picks).alias("_m")).select(
        *requests.columns, F.col("_m.model").alias("assigned_model"), F.col("_m.percentage").alias("assigned_percentage"))


def assign_credential(requests: DataFrame, tokens: DataFrame, run_col: str = "run_id") -> DataFrame:
    """credential = tokens[seq % n]; label blank -> ``user-{idx}``; a run
    without credentials uses index 0 and label ``public``.
    ``tokens`` is (run_id, token_pos 0-based, token, label)."""
    n = broadcast_if_small(tokens.groupBy(run_col).agg(F.count("*").alias("_n")))
    req = requests.join(n, run_col, "left").withColumn(
        "token_idx", F.when(F.col("_n") > 0, F.pmod(F.col("seq"), F.col("_n"))).otherwise(F.lit(0))
        .cast("long"))
    t = broadcast_if_small(tokens.select(F.col(run_col).alias("_r"), F.col("token_pos").alias("_p"),
                                         F.col("label").alias("_label"), F.col("token").alias("_token")))
    cond = (req[run_col] == t["_r"]) & (req["token_idx"] == t["_p"])
    j = req.join(t, cond, "left")
    label = F.when(F.coalesce(F.col("_n"), F.lit(0)) == 0, F.lit("public")).otherwise(
        F.coalesce(F.nullif(F.col("_label"), F.lit("")),
                   F.concat(F.lit("user-"), F.col("token_idx").cast("string"))))
    return j.select(*requests.columns, "token_idx", label.alias("assigned_label"),
                    F.sha2(F.col("_token"), 256).alias("token_sha256"))


def assign_prompt(requests: DataFrame, prompts: DataFrame, suite_col: str = "suite_id") -> DataFrame:
    """prompt = prompts_of_suite[seq % n]; a suite without prompts gives
    an empty text. ``prompts`` is (suite_id, prompt_index 0-based, text)."""
    n = broadcast_if_small(prompts.groupBy("suite_id").agg(F.count("*").alias("_n")))
    req = requests.join(n.withColumnRenamed("suite_id", suite_col), suite_col, "left").withColumn(
        "prompt_index", F.when(F.col("_n") > 0, F.pmod(F.col("seq"), F.col("_n"))).otherwise(F.lit(0))
        .cast("long"))
    p = broadcast_if_small(prompts.select(F.col("suite_id").alias("_s"), F.col("prompt_index").alias("_i"),
                                          F.col("text").alias("prompt_text")))
    cond = (req[suite_col] == p["_s"]) & (req["prompt_index"] == p["_i"])
    j = req.join(p, cond, "left")
    return j.select(*requests.columns, "prompt_index",
                    F.when(F.col("_n") > 0, F.concat_ws("-", F.col(suite_col),
                                                        (F.col("prompt_index") + 1).cast("string")))
                    .alias("assigned_prompt_id"),
                    F.coalesce(F.col("prompt_text"), F.lit("")).alias("prompt_text"))


def allocated_rates(schedule: DataFrame, runs: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Every stage x every active model of its run, with the rate
    allocated to the model (equi-join on run, not a cross join)."""
    m = runs.select(run_col, F.explode(active_models()).alias("_m")).select(
        run_col, F.col("_m.model").alias("model"), F.col("_m.percentage").alias("percentage"))
    return schedule.join(m, run_col).select(
        run_col, "stage_index", "model", "percentage", "target_rps",
        allocated_rps().alias("allocated_rps"))
