"""F5 stored: numbers of a log that grows file by file equal those of the whole log."""

import datetime as dt
import os
import random
import subprocess
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rampstat import session
from rampstat.plans.pipeline import EventRuns, event_runs
from rampstat.sources.numbered_log import NumberedLog, source_files
from tests.conftest import SF001

T0 = dt.datetime(2024, 1, 1)
COLS = "run_id long, ts timestamp, event_id long, x string"


def _log(spark, **more):
    return NumberedLog(spark, tempfile.mkdtemp(prefix="log-", dir="/tmp"), num_partitions=3, **more)


def _frame(spark, rows):
    return spark.createDataFrame([(r, T0 + dt.timedelta(seconds=t), e, f"x{e}") for r, t, e in rows], COLS)


def _numbers(rows):
    """(run, event) -> number, by sorting all rows at once."""
    out, seen = {}, {}
    for r, _, e in sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1], q[2])):
        seen[r] = seen.get(r, 0) + 1
        out[(r, e)] = seen[r]
    return out


def _check(log, rows):
    got = log.read().collect()
    assert len(got) == len(rows)
    assert {(r.run_id, r.event_id): r.seq for r in got} == _numbers(rows)
    assert all(r.x == f"x{r.event_id}" for r in got)
    assert sorted(r.event_id for r in log.read(numbered=False).collect()) == sorted(e for _, _, e in rows)


def test_files_in_order_are_added_without_sorting_older_ones_again(spark):
    log, rows = _log(spark), []
    for step in range(3):
        new = [(k % 4 or None, 1000 * step + k % 97, 1000 * step + k) for k in range(200)]
        log.add(_frame(spark, new))
        rows += new
        _check(log, rows)
    assert log.resorted == 0
    for s in range(3):  # each segment holds its own rows and no others
        assert spark.read.parquet(f"{log.path}/segments/_segment={s}").count() == 200


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_late_rows_anywhere(spark, seed):
    r = random.Random(seed)
    log, rows = _log(spark), []
    for step in range(4):
        new = [(r.choice([0, 0, 0, 1, 2, None]), r.randrange(3000) if step % 2 else 4000 * step + r.randrange(3000), 1000 * step + k) for k in range(60)]
        log.add(_frame(spark, new))
        rows += new
        _check(log, rows)
    assert log.resorted > 0


def test_late_rows_move_only_the_entries_they_fall_into(spark):
    log = _log(spark)
    first = [(run, t, 1000 * run + t) for run in range(6) for t in range(300)]
    log.add(_frame(spark, first))
    late = [(2, 150, 90_000)]  # equal time, larger event id
    log.add(_frame(spark, late))
    moved = spark.read.parquet(f"{log.path}/segments/_segment=1")
    assert moved.select("run_id").distinct().count() == 1 and moved.count() <= 301
    _check(log, first + late)
    # a row in a gap between two entries moves nothing
    log.add(_frame(spark, [(2, 1_000_000, 90_001)]))
    assert spark.read.parquet(f"{log.path}/segments/_segment=2").count() == 1
    _check(log, first + late + [(2, 1_000_000, 90_001)])


def test_a_new_run_an_empty_file_and_an_older_version(spark):
    log, rows = _log(spark), [(1, t, t) for t in range(50)]
    log.add(_frame(spark, []))
    assert log.read().collect() == []
    log.add(_frame(spark, rows))
    log.add(_frame(spark, []))
    log.add(_frame(spark, [(7, 0, 500)]))
    _check(log, rows + [(7, 0, 500)])
    again = NumberedLog(spark, log.path, num_partitions=3)  # found again by its folder
    assert again.version == 3
    _check(again, rows + [(7, 0, 500)])


def test_an_add_that_failed_counts_for_nothing(spark):
    log, rows = _log(spark), [(1, t, t) for t in range(50)]
    log.add(_frame(spark, rows))
    with pytest.raises(Exception, match="lost"):
        log.add(_frame(spark, [(1, 99, 99)]).withColumn("x", F.expr("CAST(raise_error('lost') AS STRING)")))
    _check(log, rows)
    log.add(_frame(spark, [(1, 60, 60)]))
    _check(log, rows + [(1, 60, 60)])


def test_reports_share_one_log_and_new_files_are_added(spark):
    session.release(spark)
    d = tempfile.mkdtemp(prefix="events-", dir="/tmp")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.where("event_id < 600").coalesce(1).write.parquet(f"{d}/events.parquet")
    first = event_runs(spark, d)
    assert first.requests().count() == 600
    assert event_runs(spark, d) is first and first.log.version == 0
    ev.where("event_id >= 600").coalesce(1).write.mode("append").parquet(f"{d}/events.parquet")
    second = event_runs(spark, d)
    assert second is first and second.log.version == 1
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    want = ev.withColumn("run_id", F.col("user_id") % 4).select("event_id", F.row_number().over(w).alias("seq"))
    assert {tuple(r) for r in second.requests().select("event_id", "seq").collect()} == {tuple(r) for r in want.collect()}
    # a file that is no longer what it was: nothing stored holds
    name = next(iter(source_files(spark, f"{d}/events.parquet")))
    os.utime(name.removeprefix("file:"), (1, 1))
    assert event_runs(spark, d) is not first
    assert session.release(spark) > 0
    assert event_runs(spark, d) is not second


def test_no_sort_of_the_log_when_it_is_read(spark):
    plan = EventRuns(spark, SF001).requests()._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan.lower() and "RepartitionByExpression" not in plan and "SortMergeJoin" not in plan


def test_tasks_need_no_package_on_their_path():
    """Run from another folder: Python workers find only what travels with the plan."""
    code = f"""
import sys; sys.path.insert(0, {str(Path(session.__file__).parents[1])!r})
from pyspark.sql import functions as F
from rampstat.session import build_session
from rampstat.operators.ranking import previous_in_group, running_sums
spark = build_session(master="local[2]", shuffle_partitions=2)
df = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
a = running_sums(df, ["g"], ["id"], {{"n": F.lit(1)}}).agg(F.max("n")).first()[0]
b = previous_in_group(df, ["g"], ["id"], "id").where("previous IS NULL").count()
print("FOUND", a, b)
"""
    d = tempfile.mkdtemp(prefix="elsewhere-", dir="/tmp")
    done = subprocess.run([sys.executable, "-c", code], cwd=d, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=300)
    assert "FOUND 34 3" in done.stdout, done.stderr[-2000:]
