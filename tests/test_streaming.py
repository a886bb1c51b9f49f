"""Streaming results equal batch results over the same files."""

import os
import tempfile

from pyspark.sql import functions as F

from rampstat.operators.normalize import normalize_requests
from rampstat.plans.pipeline import EventRuns
from rampstat.sources import fixtures as fx
from rampstat.streaming.live import (
    live_counters, live_latest, live_percentiles, live_requests, live_table, read_event_stream, run_available_now,
    stage_windows, start_live_progress,
)
from tests.conftest import SF001


def _split_events(spark, n_files=4):
    """events rewritten as several time-ordered files in a fresh folder."""
    d = tempfile.mkdtemp(prefix="events-stream-", dir="/tmp")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = os.path.join(d, "batch")
    ev.repartitionByRange(n_files, "ts").sortWithinPartitions("ts").write.parquet(src)
    # the file source reads files in modification-time order: make it time order
    parts = sorted(f for f in os.listdir(src) if f.endswith(".parquet"))
    for i, f in enumerate(parts):
        os.utime(os.path.join(src, f), (1_700_000_000 + i, 1_700_000_000 + i))
    return src


def test_stream_counters_equal_batch(spark):
    src = _split_events(spark)
    er = EventRuns(spark, SF001)
    stream = read_event_stream(spark, src, glob="*.parquet")
    counters = live_counters(live_requests(stream, er.runs, er.schedule))
    out = tempfile.mkdtemp(prefix="out-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    run_available_now(counters, "complete", out, ck)
    got = sorted((r.run_id, r.stage_index, r.stage_count, r.stage_successful)
                 for r in spark.read.parquet(out).collect())
    req = er.requests(with_seq=False)
    ok = (F.col("status") == "success").cast("long")
    exp = sorted(tuple(r) for r in req.groupBy("run_id", "stage_index").agg(
        F.count("*"), F.sum(ok)).collect())
    assert got == exp


def test_stage_windows_append_closed_stages(spark):
    src = _split_events(spark)
    stream = read_event_stream(spark, src, glob="*.parquet")
    wins = stage_windows(normalize_requests(fx.raw_outcomes(stream)), 259200, "1 day")
    out = tempfile.mkdtemp(prefix="out-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    run_available_now(wins, "append", out, ck)
    res = spark.read.parquet(out)
    starts = sorted({r.window_start.day for r in res.collect()})
    # 3-day stages from 2024-01-01; the last one is still open under the watermark
    assert starts[0] == 1 and all((d - 1) % 3 == 0 for d in starts)
    assert res.count() == 4 * 9
    # restart from the checkpoint: nothing new, nothing duplicated
    run_available_now(wins, "append", out, ck)
    assert spark.read.parquet(out).count() == 4 * 9


def test_live_progress_publishes_counters_and_latest(spark):
    src = _split_events(spark)
    er = EventRuns(spark, SF001)
    out = tempfile.mkdtemp(prefix="live-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    q = start_live_progress(spark, src, out, ck, er.runs, er.schedule, trigger=None)
    q.awaitTermination(300)
    latest = live_latest(spark, out).collect()
    assert len(latest) == 4 and all(r.stage_index == 9 and r.age_s > 0 for r in latest)
    counters = live_table(spark, out, "counters").read()
    assert counters.count() == 40
    assert sum(r.stage_count for r in counters.collect()) == spark.read.parquet(src).count()
    req, each = er.requests(with_seq=False), {r.run_id: r for r in live_percentiles(spark, out, ["run_id"]).collect()}
    for r in req.groupBy("run_id").agg(F.count("*").alias("n"), F.max("latency_ms").alias("top")).collect():
        assert each[r.run_id].n == r.n and 0 <= each[r.run_id].p50_latency_ms <= each[r.run_id].p99_latency_ms <= r.top
    assert live_percentiles(spark, out).count() == 40


def test_late_rows_after_the_watermark_do_not_reopen_a_stage(spark):
    import datetime as dt
    d = tempfile.mkdtemp(prefix="late-", dir="/tmp")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    a = ev.where("ts < TIMESTAMP'2024-01-05 00:00:00'")
    b = ev.where("ts >= TIMESTAMP'2024-01-20 00:00:00' AND ts < TIMESTAMP'2024-01-21 00:00:00'")
    filler = ev.where("ts >= TIMESTAMP'2024-01-21 00:00:00' AND ts < TIMESTAMP'2024-01-22 00:00:00'")
    late = ev.where("ts >= TIMESTAMP'2024-01-05 00:00:00' AND ts < TIMESTAMP'2024-01-07 00:00:00'")
    # rows are late against the watermark of the previous batch: the filler
    # batch closes stage [Jan 4, Jan 7) before the late file arrives
    for i, part in enumerate([a, b, filler, late]):
        out = os.path.join(d, f"f{i}")
        part.coalesce(1).write.parquet(out)
        f = next(x for x in os.listdir(out) if x.endswith(".parquet"))
        os.rename(os.path.join(out, f), os.path.join(d, f"events-{i}.parquet"))
        os.utime(os.path.join(d, f"events-{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    stream = read_event_stream(spark, d, glob="events-*.parquet")
    wins = stage_windows(normalize_requests(fx.raw_outcomes(stream)), 259200, "1 day")
    out = tempfile.mkdtemp(prefix="out-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="ck-", dir="/tmp")
    run_available_now(wins, "append", out, ck)
    res = spark.read.parquet(out)
    stage1 = res.where(F.col("window_start") == dt.datetime(2024, 1, 4)).groupBy().sum("total_requests").first()[0]
    early = a.where("ts >= TIMESTAMP'2024-01-04 00:00:00'").count()
    # the late file's rows (Jan 5-6) arrived after the watermark passed the stage: dropped
    assert stage1 == early
    assert res.groupBy("run_id", "window_start").count().where("count > 1").count() == 0


def test_runs_that_begin_later_and_restarts(spark):
    """A run whose configuration comes after the query's start is counted from its batch on;
    a restart from the checkpoint adds new files only and leaves a readable table."""
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    d, out, ck = (tempfile.mkdtemp(prefix=p, dir="/tmp") for p in ("src-", "live-", "ck-"))
    er = EventRuns(spark, SF001)
    known = [0, 1]

    def put(i, part):
        tmp = os.path.join(d, f"_f{i}")
        part.coalesce(1).write.parquet(tmp)
        f = next(x for x in os.listdir(tmp) if x.endswith(".parquet"))
        os.rename(os.path.join(tmp, f), os.path.join(d, f"events-{i}.parquet"))

    def go():
        q = start_live_progress(spark, d, out, ck, lambda: er.runs.where(F.col("run_id").isin(known)),
                                lambda: er.schedule.where(F.col("run_id").isin(known)), trigger=None, glob="events-*.parquet")
        q.awaitTermination()
        return {r.run_id: r.n for r in live_table(spark, out, "counters").read().groupBy("run_id").agg(F.sum("stage_count").alias("n")).collect()}

    first, second = ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")
    count = lambda df, runs: {r: df.where(f"user_id % 4 = {r}").count() for r in runs}
    put(0, first)
    assert go() == count(first, [0, 1])
    lost = {r.run_id: r.requests for r in live_table(spark, out, "unassigned").read().collect()}
    assert lost == count(first, [2, 3])
    known.append(2)
    put(1, second)
    got = go()
    assert got == {**count(ev, [0, 1]), **count(second, [2])}
    assert go() == got  # nothing new: nothing counted twice


def test_a_failing_stream_raises(spark):
    import pytest
    src = _split_events(spark)
    stream = read_event_stream(spark, src, glob="*.parquet")
    bad = stream.selectExpr("raise_error('broken row') AS x", "event_id")
    with pytest.raises(Exception, match="broken row"):
        run_available_now(bad, "append", tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp"))


def test_many_files_give_what_the_batch_gives(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    d = tempfile.mkdtemp(prefix="many-", dir="/tmp")
    ev.repartition(12).write.mode("overwrite").parquet(d)
    er = EventRuns(spark, SF001)
    want = sorted((r.run_id, r.stage_index, r.n) for r in er.requests(False).where("stage_index IS NOT NULL")
                  .groupBy("run_id", "stage_index").agg(F.count("*").alias("n")).collect())
    for limit in (1, None):
        out, ck = (tempfile.mkdtemp(prefix=p, dir="/tmp") for p in ("out-", "ck-"))
        counters = live_counters(live_requests(read_event_stream(spark, d, "*.parquet", limit), er.runs, er.schedule))
        run_available_now(counters, "complete", out, ck)
        assert sorted((r.run_id, r.stage_index, r.stage_count) for r in spark.read.parquet(out).collect()) == want


def test_a_new_folder_under_an_old_checkpoint_is_an_error(spark):
    """Counting on from zero would lose what earlier batches have counted."""
    import pytest
    src, er = _split_events(spark), EventRuns(spark, SF001)
    out, other, ck = (tempfile.mkdtemp(prefix=p, dir="/tmp") for p in ("live-", "live-", "ck-"))
    start_live_progress(spark, src, out, ck, er.runs, er.schedule, trigger=None).awaitTermination(300)
    spark.read.parquet(src).limit(5).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="lacks what batch"):
        start_live_progress(spark, src, other, ck, er.runs, er.schedule, trigger=None).awaitTermination(300)
