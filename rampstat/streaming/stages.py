"""Stages closed by the clock, for runs that are configured while the stream is up
(D12, J5-J7).

Two file streams come in: requests, and a *control* stream that says what is planned. A
``plan`` row announces a stage of a run with its first and last moment, an ``end`` row says
that a run is over (one for each of its stages), and a ``tick`` only carries the time on.

``with_plan`` joins each request to the stage that holds it - a stream-stream join under
watermarks, so a request may come before its run is known and waits for it, up to
``late``; plan rows stay as long as the ``longest`` run. Its rows are stored, and
``close_stages`` is a query of its own over them (Spark would hold its watermark back by
``longest`` behind the join): it keeps counts per stage in state and sets an event-time timer
at the end of the stage; a stage's row goes out, once, when the watermark passes its end
or the run ends, whichever is first, and stages without requests go out too. Stages may
have any lengths.

A stage can hold a third of all requests, so its state is kept in ``PARTS`` parts, by
a hash of the request; a part gives a row, and ``closed_stages`` adds the parts up.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rampstat.functions.rates import report_round

# the processor travels with the plan: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONTROL_SCHEMA = ("run_id bigint, kind string, at timestamp, stage_index int, target_rps double, active_users int, "
                  "starts timestamp, ends timestamp")

#: Parts of a stage's state: each is a key of its own.
PARTS = 8

#: State with timers needs this store.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of ``with_plan`` as they are stored.
STAGED = ["run_id", "event_id", "ts", "part", "status", "latency_ms", "stage_index", "target_rps", "active_users", "starts", "ends"]
STAGED_SCHEMA = ("run_id bigint, event_id bigint, ts timestamp, part int, status string, latency_ms double, stage_index int, target_rps double, "
                 "active_users int, starts timestamp, ends timestamp")

CLOSED = ("run_id long, stage_index int, part int, starts timestamp, ends timestamp, target_rps double, active_users int, "
          "total_requests long, successful long, latency_sum double, closed_by string")
_STATE = "starts long, ends long, target double, users int, n long, ok long, latency double, closed boolean"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state with timers."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        value = spark.conf.get(key, None)
        if value is not None:
            own.conf.set(key, value)
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return own


def plan_rows(schedule: DataFrame, runs: DataFrame, announced: str = "started_at", run_col: str = "run_id") -> DataFrame:
    """The control rows that announce the stages of ``runs`` at the time ``announced`` (SQL)."""
    at = lambda c: F.timestamp_micros(F.unix_micros("started_at") + F.round(F.col(c) * 1e6).cast("long"))
    return schedule.join(runs.select(run_col, "started_at", F.expr(announced).alias("at")), run_col).select(
        F.col(run_col).cast("long").alias("run_id"), F.lit("plan").alias("kind"), "at", F.col("stage_index").cast("int").alias("stage_index"),
        "target_rps", F.col("active_users").cast("int").alias("active_users"), at("t0_offset_s").alias("starts"), at("t1_offset_s").alias("ends"))


def end_rows(plans: DataFrame, ended: str | None = None) -> DataFrame:
    """The control rows that say that the runs of ``plans`` are over: at the end of their
    last stage, or at ``ended`` (SQL)."""
    when = F.expr(ended) if ended else F.col("last")
    last = plans.groupBy("run_id").agg(F.max("ends").alias("last"))
    return plans.join(last, "run_id").select("run_id", F.lit("end").alias("kind"), when.alias("at"), "stage_index", "target_rps", "active_users", "starts", "ends")


def tick_rows(spark: SparkSession, at: str) -> DataFrame:
    return spark.sql(f"SELECT CAST(NULL AS BIGINT) run_id, 'tick' kind, TIMESTAMP '{at}' at, CAST(NULL AS INT) stage_index, CAST(NULL AS DOUBLE) target_rps, "
                     "CAST(NULL AS INT) active_users, CAST(NULL AS TIMESTAMP) starts, CAST(NULL AS TIMESTAMP) ends")


def read_control_stream(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(CONTROL_SCHEMA).parquet(directory)


def _of_kind(kind: str, parts):
    """``parts`` for rows of one kind, nothing for others. The condition reads ``at`` as well, so
    that it is not moved under the watermark: rows of every kind carry the time on."""
    return F.explode(F.when((F.col("kind") == kind) & F.col("at").isNotNull(), parts))


def _all_parts(parts: int):
    return F.sequence(F.lit(0), F.lit(parts - 1))


def with_plan(requests: DataFrame, control: DataFrame, delay: str = "1 hour", late: str = "1 hour", longest: str = "31 days",
              parts: int = PARTS) -> DataFrame:
    """Requests with the stage that holds them, ``starts <= ts < ends``. Replayed
    requests (same run and ``event_id``) count once. ``delay``: how far the streams' rows are out
    of order; ``late``: how long after a request its run may be announced."""
    r = (requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_id", "event_id"])
         .withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("int")))
    p = control.withWatermark("at", delay).select(
        F.col("run_id").alias("_run"), "at", "stage_index", "target_rps", "active_users", "starts", "ends", _of_kind("plan", _all_parts(parts)).alias("_part"))
    on = ((F.col("run_id") == F.col("_run")) & (F.col("part") == F.col("_part")) & (F.col("ts") >= F.col("starts")) & (F.col("ts") < F.col("ends"))
          & (F.col("at") <= F.col("ts") + F.expr(f"INTERVAL {late}")) & (F.col("at") >= F.col("ts") - F.expr(f"INTERVAL {longest}")))
    return r.join(p, on).select(*STAGED)


def read_staged_stream(spark: SparkSession, directory: str) -> DataFrame:
    return spark.readStream.schema(STAGED_SCHEMA).parquet(directory)


class StageClock(StatefulProcessor):
    """Counts of one part of a stage, given out when its timer expires or its run ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", _STATE)

    def _row(self, key, s, by: str) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "stage_index": [key[1]], "part": [key[2]], "starts": pd.to_datetime([s[0]], unit="us", utc=True),
                             "ends": pd.to_datetime([s[1]], unit="us", utc=True), "target_rps": [s[2]], "active_users": [s[3]], "total_requests": [s[4]],
                             "successful": [s[5]], "latency_sum": [s[6]], "closed_by": [by]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.counts.get()) if self.counts.exists() else None
        over = False
        for batch in rows:
            if state is None:
                first = batch.iloc[0]
                state = [int(first["starts_us"]), int(first["ends_us"]), float(first["target_rps"]), int(first["active_users"]), 0, 0, 0.0, False]
                expires = -(-state[1] // 1000)
                if timerValues.getCurrentWatermarkInMs() >= expires:
                    return  # closed and forgotten
                self.handle.registerTimer(expires)
            if not state[7]:  # what comes after the run's end is late
                asked = batch[batch["kind"] == "request"]
                state[4] += len(asked)
                state[5] += int((asked["status"] == "success").sum())
                state[6] += float(asked["latency_ms"].sum())
            over |= bool((batch["kind"] == "end").any())
        if over and not state[7]:
            state[7] = True
            yield self._row(key, state, "end")
        self.counts.update(tuple(state))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.counts.get()
        if not state[7]:
            yield self._row(key, state, "timer")
        self.counts.clear()

    def close(self) -> None:
        pass


_INPUT = ["run_id", "stage_index", "part", "ts", "kind", "status", "latency_ms", "target_rps", "active_users"]


def _clocked(df: DataFrame) -> DataFrame:
    return df.select(*_INPUT, F.unix_micros("starts").alias("starts_us"), F.unix_micros("ends").alias("ends_us"))


def close_stages(staged: DataFrame, control: DataFrame, delay: str = "1 hour", parts: int = PARTS) -> DataFrame:
    """A row for each part of a stage, appended when the stage is over. ``staged``:
    stored requests of ``with_plan``, with as many ``parts``; ``delay``: how far they may be out
    of order, the time included that they waited for their run."""
    staged = staged.withWatermark("ts", delay)
    c = control.withWatermark("at", delay)
    word, number = F.lit(None).cast("string"), F.lit(0.0)
    told = lambda kind, which: c.select(
        "run_id", "stage_index", _of_kind(kind, which).alias("part"), F.col("at").alias("ts"), F.lit(kind).alias("kind"), word.alias("status"),
        number.alias("latency_ms"), "target_rps", "active_users", "starts", "ends")
    rows = _clocked(staged.withColumn("kind", F.lit("request")))
    # a plan row starts the clock of one part, so a stage without requests is closed too
    rows = rows.unionByName(_clocked(told("plan", F.array(F.lit(0))))).unionByName(_clocked(told("end", _all_parts(parts))))
    return rows.groupBy("run_id", "stage_index", "part").transformWithStateInPandas(
        StageClock(), outputStructType=CLOSED, outputMode="append", timeMode="eventTime")


def closed_stages(parts: DataFrame) -> DataFrame:
    """The stages whose parts ``close_stages`` has given out."""
    p = parts.groupBy("run_id", "stage_index", "starts", "ends").agg(
        F.max("target_rps").alias("target_rps"), F.max("active_users").alias("active_users"), F.sum("total_requests").alias("total_requests"),
        F.sum("successful").alias("successful"), F.sum("latency_sum").alias("_latency"))
    avg = F.when(F.col("total_requests") > 0, report_round(F.col("_latency") / F.col("total_requests"), 6)).otherwise(F.lit(0.0))
    return p.withColumn("avg_latency_ms", avg).drop("_latency")
