"""E1/E3/E4/E16 kept up to date, and KLL sketches that merge."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from rampstat.operators import profiles as prof
from rampstat.operators.aggregate import latency_profile, multi_grain_rollup
from rampstat.streaming.keyed_table import KeyedTable
from tests.helpers import request_df


def _requests(spark, n=400, seed=1):
    r = random.Random(seed)
    return request_df(spark, [{"run_id": r.choice([0, 0, 0, 1]), "stage_index": r.choice([0, 1, None]), "model": r.choice(["a", "b", None]),
                               "status": r.choice(["success", "success", "timeout"]), "latency_ms": float(r.choice([0, r.randrange(50)]))} for _ in range(n)])


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_adding_in_steps_gives_what_one_pass_gives(spark):
    req = _requests(spark)
    store = prof.ProfileStore(spark, tempfile.mkdtemp(prefix="profiles-", dir="/tmp"))
    for k in range(3):
        part = req.where(F.pmod("seq", F.lit(3)) == k)
        store.add(part, k)
        store.add(part, k)  # the batch runs again
    assert _rows(store.rollup()) == _rows(multi_grain_rollup(req))
    for cols in (["run_id", "stage_index"], ["run_id", "model"], ["run_id"], ["model"]):
        assert _rows(store.profiles(cols)) == _rows(latency_profile(req, cols))


def test_the_rollup_scans_the_log_once(spark):
    d = tempfile.mkdtemp(prefix="req-", dir="/tmp")
    _requests(spark).write.mode("overwrite").parquet(d)
    from rampstat.operators.aggregate import rollup_histogram
    plan = rollup_histogram(prof.request_histogram(spark.read.parquet(d)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Expand" in plan and "Union" not in plan


@pytest.mark.parametrize("parts", [1, 7])
def test_merged_sketches_keep_the_bound(spark, parts):
    df = spark.range(60_000).select((F.col("id") % 5).alias("run_id"), (F.col("id") % parts).alias("stage_index"),
                                    (F.abs(F.hash("id")) % 20_011 / 7.0).alias("latency_ms"))
    df = df.withColumn("run_id", F.when(F.col("run_id") < 3, F.lit(0)).otherwise(F.col("run_id")))  # one holds most
    merged = prof.merged_sketches(prof.latency_sketches(df, ["run_id", "stage_index"]), ["run_id"])
    for r in prof.sketch_rank_error(df, merged, ["run_id"]).collect():
        assert r.p50_within and r.p95_within and r.p99_within
    assert prof.KLL_ERROR < 0.01
    n = {r.run_id: r.n for r in prof.sketched_percentiles(merged, ["run_id"]).collect()}
    assert n == {r.run_id: r["count"] for r in df.groupBy("run_id").count().collect()}


def test_sketches_of_batches_in_a_keyed_table(spark):
    df = spark.range(9000).select((F.col("id") % 2).alias("run_id"), F.lit(0).alias("stage_index"), (F.col("id") * 0.5).alias("latency_ms"))
    t = KeyedTable(spark, tempfile.mkdtemp(prefix="kll-", dir="/tmp"), ["run_id", "stage_index"], sketches=["sketch"], least_rows=3)
    for k in range(4):
        t.publish(prof.latency_sketches(df.where(F.col("latency_ms").between(k * 1125, k * 1125 + 1124.9)), ["run_id", "stage_index"]), k)
    for r in prof.sketch_rank_error(df, prof.merged_sketches(t.read(), ["run_id"]), ["run_id"]).collect():
        assert r.n == 4500 and r.p50_within and r.p99_within


def test_a_group_without_requests_has_no_sketch(spark):
    empty = _requests(spark).where("run_id = 99")
    assert prof.latency_sketches(empty, ["run_id"]).collect() == []
