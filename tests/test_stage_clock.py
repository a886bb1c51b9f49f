"""Stages of any length closed by timers and run ends, runs announced late."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from rampstat.streaming import stages as st
from rampstat.streaming.live import run_available_now

T0 = dt.datetime(2024, 1, 1)
REQUEST = "run_id long, event_id long, ts timestamp, status string, latency_ms double"


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def own(spark):
    s = st.stateful_session(spark)
    s.conf.set("spark.sql.shuffle.partitions", "2")
    return s


class Log:
    """A stream whose files come step by step; every step resumes from the checkpoint."""

    def __init__(self, own, late):
        self.own, self.d, self.late = own, tempfile.mkdtemp(prefix="clock-", dir="/tmp"), late

    def step(self, requests=(), control=()):
        self.own.createDataFrame(list(requests), REQUEST).coalesce(1).write.mode("append").parquet(f"{self.d}/requests")
        self.own.createDataFrame(list(control), st.CONTROL_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.d}/control")
        r = self.own.readStream.schema(REQUEST).parquet(f"{self.d}/requests")
        c = st.read_control_stream(self.own, f"{self.d}/control")
        run_available_now(st.with_plan(r, c, delay="1 second", late=self.late, parts=2), "append", f"{self.d}/staged", f"{self.d}/ck1")
        closed = st.close_stages(st.read_staged_stream(self.own, f"{self.d}/staged"), c, delay=self.late, parts=2)
        run_available_now(closed, "append", f"{self.d}/out", f"{self.d}/ck2")
        out = self.own.read.parquet(f"{self.d}/out")
        return {(r.run_id, r.stage_index): (r.total_requests, r.successful) for r in st.closed_stages(out).collect()}

    def how(self):
        out = self.own.read.parquet(f"{self.d}/out")
        return {(r[0], r[1]): r[2] for r in out.groupBy("run_id", "stage_index").agg(F.min("closed_by")).collect()}


LENGTHS = [10, 300, 7, 100]


def plan(run, announced=0, lengths=LENGTHS, start=0):
    out, t = [], start
    for i, n in enumerate(lengths):
        out.append((run, "plan", at(announced), i, 1.0 + i, i + 1, at(t), at(t + n)))
        t += n
    return out


def end(run, when, lengths=LENGTHS, start=0):
    return [(r, "end", at(when), i, tr, u, s, e) for r, _, _, i, tr, u, s, e in plan(run, 0, lengths, start)]


def tick(when):
    return [(None, "tick", at(when), None, None, None, None, None)]


def requests(run, times, first=0):
    return [(run, first + k, at(t), "success" if k % 3 else "failure", float(k)) for k, t in enumerate(times)]


@pytest.fixture(scope="module")
def story(own):
    """Six runs in one log, in four steps; what is closed after each."""
    log = Log(own, late="60 seconds")
    all_runs = (1, 2, 3, 4, 5, 6)
    replayed = requests(3, [1, 2, 3], 300)
    done = [log.step(
        # stage 2, from 310 to 317, has no requests
        requests(1, [0, 1, 9.999999], 100) + requests(2, [1, 12], 200) + replayed * 2 + requests(4, [-1, 417, 500], 400) + requests(9, [1, 2], 900)
        + requests(5, [1], 500) + requests(6, [k / 500 for k in range(4000)], 10_000),
        [r for k in all_runs if k != 2 for r in plan(k)])]
    done.append(log.step(requests(1, [10, 100, 200], 110) + requests(2, [30], 210) + replayed + requests(5, [11], 510),
                         plan(2, announced=60) + end(5, 62) + tick(200)))
    done.append(log.step(requests(1, [309.5, 317, 399], 120) + requests(5, [205], 520), tick(400)))
    done.append(log.step(requests(1, [416], 130), [r for k in all_runs if k != 5 for r in end(k, 480)]))
    return log, done


def of_run(got, run):
    return {stage: counts for (r, stage), counts in got.items() if r == run}


def test_stages_of_unequal_length_close_one_by_one_and_the_last_by_the_runs_end(story):
    log, done = story
    assert done[0] == {}
    assert of_run(done[1], 1) == {0: (3, 2)}  # the watermark is past 10 s, not past 310
    assert of_run(done[2], 1) == {0: (3, 2), 1: (4, 2), 2: (0, 0)}
    assert of_run(done[3], 1) == {0: (3, 2), 1: (4, 2), 2: (0, 0), 3: (3, 2)}
    how = log.how()
    assert how[(1, 3)] == "end" and {how[(1, i)] for i in range(3)} == {"timer"}


def test_a_run_announced_after_its_first_requests(story):
    assert of_run(story[1][3], 2) == {0: (1, 0), 1: (2, 1), 2: (0, 0), 3: (0, 0)}


def test_replayed_requests_count_once(story):
    assert of_run(story[1][3], 3)[0] == (3, 2)


def test_requests_outside_every_stage_and_of_unknown_runs_are_no_stage(story):
    assert of_run(story[1][3], 4) == {i: (0, 0) for i in range(4)} and not of_run(story[1][3], 9)


def test_ended_early_closes_every_stage_once(story):
    log, done = story
    assert of_run(done[1], 5) == {0: (1, 0), 1: (1, 0), 2: (0, 0), 3: (0, 0)}
    assert of_run(done[3], 5) == of_run(done[1], 5)  # a request after the run's end is late
    parts = log.own.read.parquet(f"{log.d}/out").groupBy("run_id", "stage_index", "part").count()
    assert parts.where("count > 1").count() == 0  # closed once each


def test_a_hot_stage_is_kept_in_parts(story):
    log, done = story
    assert of_run(done[3], 6)[0][0] == 4000
    parts = log.own.read.parquet(f"{log.d}/out").where("run_id = 6 AND stage_index = 0").select("total_requests").collect()
    assert len(parts) == 2 and min(r[0] for r in parts) > 1500


def test_plan_rows_follow_the_schedule(spark):
    from tests.helpers import schedule_df
    schedule = schedule_df(spark, [(0, 1.0, 1, 10.0), (1, 2.0, 2, 300.0), (2, 4.0, 3, 0.5)], run_id=4)
    runs = spark.createDataFrame([(4, T0)], "run_id long, started_at timestamp")
    plans = st.plan_rows(schedule, runs).orderBy("stage_index").collect()
    assert [((r.starts - T0).total_seconds(), (r.ends - T0).total_seconds()) for r in plans] == [(0, 10), (10, 310), (310, 310.5)]
    ends = st.end_rows(st.plan_rows(schedule, runs)).collect()
    assert len(ends) == 3 and {r.at for r in ends} == {plans[-1].ends}
