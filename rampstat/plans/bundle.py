"""The report bundle of a set of runs - five tables and the chart series, from one stored log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rampstat.operators import aggregate as agg
from rampstat.operators import report as rep
from rampstat.plans.pipeline import EventRuns
from rampstat.session import materialize, scratch_path
from rampstat.sources.request_log import ReportBundles, stage_report


def run_configurations(er: EventRuns) -> DataFrame:
    """The event runs' configurations with all that the config table lists."""
    tokens = er.users.groupBy("run_id").agg(F.count("*").alias("token_count"))  # a credential for each user
    return er.runs.join(tokens, "run_id").withColumns({"benchmark_suite": F.lit("coding"), "timeout": F.lit(60.0)})


def write_bundle(er: EventRuns, bundles: ReportBundles, unit: str = "rps") -> int:
    """Every report of the stored log, committed as one bundle; returns its version."""
    log = er.requests()
    stages = materialize(agg.stage_metrics(log, er.schedule), "stages")
    return bundles.commit({
        "config": rep.config_key_values(run_configurations(er)),
        "stage_summary": stage_report(stages, unit),
        "model_summary": agg.model_summary(log, use_seq=True),
        "raw_requests": rep.raw_report(log, stages, unit),
        "errors": rep.error_report(log),
        "rate_series": rep.rate_series(stages),
    }, unit)


def bundle_part(er: EventRuns, part: str) -> DataFrame:
    """One table of the log's bundle, which is written when the first is asked for."""
    if er.bundles is None:
        er.bundles = ReportBundles(er.spark, scratch_path(er.spark, "bundles"))
    if er.bundled != er.log.version:
        write_bundle(er, er.bundles)
        er.bundled = er.log.version
    return er.bundles.parts()[part]
