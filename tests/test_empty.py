"""Empty input per operator: typed empty results, never padded rows
(A11), and zero rows for planned stages without requests (D2)."""

from pyspark.sql import functions as F

from rampstat.operators.aggregate import model_summary, multi_grain_rollup, run_summary, stage_metrics
from rampstat.operators.progress import latest_snapshot
from rampstat.operators.quality import audit_run_config
from rampstat.operators.ranking import row_number_in_group, running_sums
from rampstat.operators.report import error_report, raw_report
from rampstat.schema import REQUEST
from tests.helpers import schedule_df


def empty_requests(spark):
    return spark.createDataFrame([], REQUEST).withColumn("event_id", F.col("seq"))


def test_empty_log(spark):
    req = empty_requests(spark)
    sch = schedule_df(spark, [(0, 1.0, 1, 10.0), (1, 2.0, 2, 10.0)])
    rows = stage_metrics(req, sch).collect()
    assert len(rows) == 2 and all(r.total_requests == 0 and r.p99_latency_ms == 0.0 for r in rows)
    assert model_summary(req).count() == 0
    assert run_summary(req).count() == 0
    assert multi_grain_rollup(req).count() == 0
    assert error_report(req).count() == 0
    assert raw_report(req, stage_metrics(req, sch)).count() == 0
    assert latest_snapshot(req, "2024-02-01 00:00:00").count() == 0


def test_empty_running_sums(spark):
    df = spark.createDataFrame([], "g int, x long")
    assert running_sums(df, ["g"], ["x"], {"c": F.lit(1)}).count() == 0
    assert row_number_in_group(df, ["g"], ["x"]).count() == 0


def test_empty_configs(spark):
    cfg = spark.createDataFrame(
        [], "run_id bigint, tokens array<struct<token:string,label:string>>, "
            "models array<struct<model:string,percentage:double>>, rate_unit string, initial_rate double, "
            "max_rate double, min_users int, max_users int, users_increment int, scaling_factor double, "
            "time_increment double")
    assert audit_run_config(cfg).count() == 0
