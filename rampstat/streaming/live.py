"""Live progress with Structured Streaming.

The request log arrives as files; each micro-batch is normalised, joined to
the static stage plan (stream-static join, D12) and folded into per-stage
state:

* ``live_counters`` (J1/J7): running counts, successes, failures, mean
  latency per (run, stage) - update mode into a ``KeyedTable``, or complete mode;
* ``stage_windows`` (J5/J6): stages as tumbling event-time windows; with a
  watermark the final row of a stage is appended once its slot has closed.
  ``dropDuplicatesWithinWatermark`` discards replayed requests.

Sinks write under the session's checkpoint directory (shared storage on a
cluster), so a restarted query resumes from its checkpoint (J8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.functions.rates import report_round
from rampstat.operators.assign import assign_stage, cap_users
from rampstat.operators.normalize import normalize_requests
from rampstat.operators.profiles import KLL_K, merged_sketches, sketched_percentiles
from rampstat.operators.schedule import build_schedule
from rampstat.session import materialize, prepare, scratch_path
from rampstat.sources import fixtures as fx
from rampstat.streaming import stages
from rampstat.streaming.keyed_table import KeyedTable

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def read_event_stream(spark: SparkSession, directory: str, glob: str = "events*.parquet",
                      max_files_per_trigger: int | None = 1) -> DataFrame:
    """File stream of raw events with an explicit schema. A limit of files only
    bounds a batch; None takes all new files at each trigger, so that a live
    query catches up with a backlog."""
    reader = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(directory)


def live_requests(stream: DataFrame, runs: DataFrame, schedule: DataFrame) -> DataFrame:
    """Normalised request stream with stage, users and target."""
    return assign_stage(normalize_requests(fx.raw_outcomes(stream)), schedule, runs)


def live_counters(requests: DataFrame) -> DataFrame:
    """Per (run, stage) counters - the progress cards."""
    ok = (F.col("status") == "success").cast("long")
    return requests.where(F.col("stage_index").isNotNull()).groupBy("run_id", "stage_index").agg(
        F.count("*").cast("long").alias("stage_count"),
        F.sum(ok).cast("long").alias("stage_successful"),
        (F.count("*") - F.sum(ok)).cast("long").alias("stage_failed"),
        F.max("target_rps").alias("target_rps"),
        F.max("active_users").alias("active_users"),
        F.max("ts").alias("last_ts"),
        F.avg("latency_ms").alias("_avg"))


def latest_state(requests: DataFrame, order_cols=("ts", "event_id")) -> DataFrame:
    """The latest progress state per run - last write wins by arrival
    order (``max_by``, a streaming-safe aggregate) - plus the request total."""
    key = F.struct(*order_cols)
    return requests.groupBy("run_id").agg(
        F.max_by(F.struct("stage_index", "ts", "target_rps", "active_users"), key).alias("_l"),
        F.count("*").cast("long").alias("total_metrics"),
    ).select("run_id", F.col("_l.stage_index").alias("stage_index"), F.col("_l.ts").alias("last_ts"),
             F.col("_l.target_rps").alias("target_rps"), F.col("_l.active_users").alias("active_users"),
             "total_metrics")


def stage_windows(requests: DataFrame, stage_seconds: int, start_offset: str,
                  watermark: str = "1 hour") -> DataFrame:
    """Tumbling windows of the stage length aligned to the run start
    (``start_offset`` = run start modulo the window length); appended when
    the watermark passes the window end."""
    dur = f"{int(stage_seconds)} seconds"
    ok = (F.col("status") == "success").cast("long")
    return (requests.withWatermark("ts", watermark)
            .dropDuplicatesWithinWatermark(["run_id", "event_id"])
            .groupBy("run_id", F.window("ts", dur, dur, start_offset).alias("w"))
            .agg(F.count("*").cast("long").alias("total_requests"),
                 F.sum(ok).cast("long").alias("successful"),
                 F.avg("latency_ms").alias("_avg"))
            .select("run_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "total_requests", "successful",
                    report_round(F.col("_avg"), 6).alias("avg_latency_ms")))


#: The tables of a live query: their keys, and how rows of a key become one.
LIVE_TABLES = {
    "counters": {"keys": ["run_id", "stage_index"], "sums": ["stage_count", "stage_successful", "stage_failed", "latency_sum"],
                 "newest": ["target_rps", "active_users", "last_ts"]},
    "latest": {"keys": ["run_id"], "ordered_by": ["last_ts", "stage_index"]},
    "unassigned": {"keys": ["run_id"], "sums": ["requests"]},
    "latencies": {"keys": ["run_id", "stage_index"], "sketches": ["sketch"]},
}


def live_table(spark: SparkSession, out_dir: str, name: str, stream: str = "") -> KeyedTable:
    return KeyedTable(spark, f"{out_dir.rstrip('/')}/{name}", stream=stream, **LIVE_TABLES[name])


def live_latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per run the stage with the newest request - last write wins -, its counts, and the
    age of that request now."""
    counts = live_table(spark, out_dir, "counters").read().select("run_id", "stage_index", "stage_count", "stage_successful", "stage_failed")
    age = (F.unix_micros(F.current_timestamp()) - F.unix_micros("last_ts")).cast("double") / F.lit(1e6)
    return live_table(spark, out_dir, "latest").read().join(counts, ["run_id", "stage_index"]).withColumn("age_s", age)


def live_percentiles(spark: SparkSession, out_dir: str, group_cols=("run_id", "stage_index")) -> DataFrame:
    """E2 of a live query: percentiles of each stage, or of each run, from the merged sketches
    of its batches."""
    sketches = live_table(spark, out_dir, "latencies").read()
    return sketched_percentiles(merged_sketches(sketches, list(group_cols)), list(group_cols))


def start_live_progress(spark: SparkSession, source_dir: str, out_dir: str, checkpoint: str,
                        runs, schedule, trigger: str | None = "2 seconds", glob: str = "*.parquet"):
    """Start the live progress query.

    ``runs`` and ``schedule`` are DataFrames, or functions without arguments that
    give them and are asked anew for every batch, so runs that begin while the
    query is up are known as soon as their configuration is. Users are those of the
    schedule (``cap_users`` holds a private run's to its credentials).

    Every trigger (2 s by default, like the dashboard refresh) takes all new request
    files, assigns stages, and writes what the batch adds to four ``KeyedTable``s under
    ``out_dir``: ``counters`` (a row per run and stage), ``latest`` (a row per run),
    ``unassigned`` (requests per run that no known stage holds) and ``latencies`` (a KLL sketch
    per run and stage). A batch writes rows of the
    keys it holds and no others; one that runs again after a restart adds nothing
    twice; a lost folder is an error. ``trigger=None`` processes what is available and stops."""
    stream = normalize_requests(fx.raw_outcomes(read_event_stream(spark, source_dir, glob, None)))
    now = lambda x: x() if callable(x) else x
    tables = {name: live_table(spark, out_dir, name, checkpoint) for name in LIVE_TABLES}

    def run(batch: DataFrame, epoch: int) -> None:
        staged = assign_stage(batch, now(schedule), now(runs))
        ok = (F.col("status") == "success").cast("long")
        added = staged.groupBy("run_id", "stage_index").agg(
            F.count("*").alias("stage_count"), F.sum(ok).alias("stage_successful"), F.sum(1 - ok).alias("stage_failed"),
            F.max("target_rps").alias("target_rps"), F.max("active_users").alias("active_users"),
            F.max("ts").alias("last_ts"), F.sum("latency_ms").alias("latency_sum"),
            F.kll_sketch_agg_double("latency_ms", F.lit(KLL_K)).alias("sketch")).persist()  # a row per run and stage, read four times
        try:
            held = added.where("stage_index IS NOT NULL")
            tables["latencies"].publish(held.select("run_id", "stage_index", "sketch"), epoch)
            held = held.drop("sketch")
            tables["counters"].publish(held, epoch)
            last = F.max_by(F.struct("stage_index", "last_ts", "target_rps", "active_users"), F.struct("last_ts", "stage_index"))
            tables["latest"].publish(held.groupBy("run_id").agg(last.alias("s")).select("run_id", "s.*"), epoch)
            tables["unassigned"].publish(added.where("stage_index IS NULL").select("run_id", F.col("stage_count").alias("requests")), epoch)
        finally:
            added.unpersist()

    w = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(run)
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.start()


_scratch = scratch_path


def run_available_now(df: DataFrame, mode: str, out_dir: str, ckpt_dir: str, table: KeyedTable | None = None):
    """Run a streaming query over everything available, to its end, and leave the
    result in ``out_dir``; a query that fails raises. Complete mode publishes each
    batch beside ``out_dir`` (``publisher``) and writes the last one there, so
    ``out_dir`` is whole from the moment it exists; update mode writes the changed rows to
    ``table``; append mode uses the file sink."""
    w = df.writeStream.option("checkpointLocation", ckpt_dir).trigger(availableNow=True)
    if mode == "complete":
        q = w.outputMode("complete").foreachBatch(publisher(f"{out_dir}-batches")).start()
    elif mode == "update":
        q = w.outputMode("update").foreachBatch(table.publish).start()
    else:
        q = w.outputMode("append").format("parquet").option("path", out_dir).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if mode == "complete":
        latest_result(df.sparkSession, f"{out_dir}-batches").write.mode("overwrite").parquet(out_dir)
    return q


#: Published results that stay for readers of an older one.
KEPT_BATCHES = 10


def _folder(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publisher(out_dir: str):
    """A ``foreachBatch`` writer of whole results. A batch writes a folder of its own,
    so readers never see an older result empty or half written; a batch that runs
    again after a restart replaces its own folder only. Old folders go."""
    def publish(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={epoch:012d}")
        if epoch >= KEPT_BATCHES:
            at, fs = _folder(batch.sparkSession, f"{out_dir}/batch={epoch - KEPT_BATCHES:012d}")
            fs.delete(at, True)
    return publish


def latest_result(spark: SparkSession, out_dir: str) -> DataFrame:
    """The newest whole result that a ``publisher`` has left under ``out_dir``."""
    at, fs = _folder(spark, f"{out_dir}/batch=*/_SUCCESS")
    whole = sorted(s.getPath().getParent().toString() for s in fs.globStatus(at) or [])
    if not whole:
        raise FileNotFoundError(f"no finished batch under {out_dir}")
    return spark.read.parquet(whole[-1])


def _event_runs(spark: SparkSession, sf_dir: str):
    """Runs and schedule of the events; B17 holds a private run's users to its credentials."""
    events = fx.table(spark, sf_dir, "events")
    runs = fx.event_runs(events)
    return runs, cap_users(build_schedule(runs), runs, fx.run_users(fx.raw_outcomes(events)))


def stream_progress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 over the events file of ``sf_dir`` as a stream, in update mode: each batch
    writes the counters it has changed; returns the table at the end."""
    prepare(spark)
    runs, schedule = _event_runs(spark, sf_dir)
    stream = read_event_stream(spark, sf_dir, "events.parquet", None)
    counters = live_counters(live_requests(stream, runs, schedule))
    out, ck = _scratch(spark, "stream-progress"), _scratch(spark, "stream-progress-ckpt")
    table = KeyedTable(spark, out, ["run_id", "stage_index"], stream=ck)
    run_available_now(counters, "update", out, ck, table)
    return table.read().select("run_id", "stage_index", "stage_count", "stage_successful", "stage_failed",
                               "target_rps", "active_users", report_round(F.col("_avg"), 6).alias("avg_latency_ms"))


def live_progress_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live query over events that arrive in two parts; it stops after the first and
    resumes. Per stage: counts, and whether it is the one its run shows last."""
    prepare(spark)
    events = fx.table(spark, sf_dir, "events")
    runs, schedule = (materialize(x, "live") for x in _event_runs(spark, sf_dir))
    d = _scratch(spark, "live-progress")
    for since, until in zip(ARRIVALS[:-1], ARRIVALS[1:]):
        last = until == ARRIVALS[-1]
        events.where(f"ts >= TIMESTAMP '{since}'" + ("" if last else f" AND ts < TIMESTAMP '{until}'")).write.mode("append").parquet(f"{d}/events")
        q = start_live_progress(spark, f"{d}/events", f"{d}/live", f"{d}/checkpoint", runs, schedule, trigger=None)
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    shown = live_latest(spark, f"{d}/live").select("run_id", "stage_index", F.col("stage_count").alias("_shown"))
    counters = live_table(spark, f"{d}/live", "counters").read()
    return counters.join(shown, ["run_id", "stage_index"], "left").select(
        "run_id", "stage_index", "stage_count", "stage_successful", "stage_failed", "target_rps", "active_users", "last_ts",
        (F.coalesce(F.col("_shown"), F.lit(-1)) == F.col("stage_count")).alias("shown"))


def stream_latest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 over the events file as a stream (complete mode, one row per run)."""
    prepare(spark)
    runs, schedule = _event_runs(spark, sf_dir)
    stream = read_event_stream(spark, sf_dir, "events.parquet", None)
    latest = latest_state(live_requests(stream, runs, schedule))
    out, ck = _scratch(spark, "stream-latest"), _scratch(spark, "stream-latest-ckpt")
    run_available_now(latest, "complete", out, ck)
    return spark.read.parquet(out)


#: The driver query's stream arrives in so many parts, cut by time; runs with an odd id are
#: announced so late.
ARRIVALS = ["2024-01-01 00:00:00", "2024-01-16 00:00:00", "2024-02-01 00:00:00"]
ANNOUNCED_LATE = "1 day"


def stream_stage_final_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages closed by timers and run ends. Requests and the runs' plans arrive
    part by part; some runs are announced after their first requests; the query
    stops after each part and resumes from its checkpoint."""
    prepare(spark)
    events = fx.table(spark, sf_dir, "events")
    runs = materialize(fx.event_runs(events), "runs")
    users = fx.run_users(fx.raw_outcomes(events))
    schedule = cap_users(build_schedule(runs), runs, users)
    plans = materialize(stages.plan_rows(schedule, runs, f"started_at + CASE WHEN run_id % 2 = 1 THEN INTERVAL {ANNOUNCED_LATE} ELSE INTERVAL 0 DAYS END"), "plans")
    own = stages.stateful_session(spark)
    d = _scratch(spark, "stream-stages")
    for k, (since, until) in enumerate(zip(ARRIVALS[:-1], ARRIVALS[1:])):
        last = k == len(ARRIVALS) - 2
        within = lambda c: f"{c} < TIMESTAMP '{until}'" if k == 0 else f"{c} >= TIMESTAMP '{since}'" + ("" if last else f" AND {c} < TIMESTAMP '{until}'")  # noqa: B023, E731
        events.where(within("ts")).write.mode("append").parquet(f"{d}/requests")
        told = plans.where(within("at")).unionByName(stages.tick_rows(spark, until))
        (told.unionByName(stages.end_rows(plans)) if last else told).write.mode("append").parquet(f"{d}/control")
        requests = normalize_requests(fx.raw_outcomes(read_event_stream(own, f"{d}/requests", "*.parquet", None)))
        control = stages.read_control_stream(own, f"{d}/control")
        run_available_now(stages.with_plan(requests, control, late=ANNOUNCED_LATE), "append", f"{d}/staged", f"{d}/staged-checkpoint")
        closed = stages.close_stages(stages.read_staged_stream(own, f"{d}/staged"), control, delay=f"{ANNOUNCED_LATE} 1 hour")
        run_available_now(closed, "append", f"{d}/closed", f"{d}/closed-checkpoint")
    return stages.closed_stages(spark.read.parquet(f"{d}/closed")).select(
        "run_id", "stage_index", F.col("starts").alias("window_start"), F.col("ends").alias("window_end"), "target_rps", "active_users",
        "total_requests", "successful", "avg_latency_ms")
