"""Composed plans over the driver tables: the normalised request log and the
run tables every report reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.operators.assign import assign_stage, cap_users, with_sequence
from rampstat.operators.normalize import normalize_requests
from rampstat.operators.schedule import build_schedule
from rampstat.session import materialize, on_release, prepare, scratch_path
from rampstat.sources import fixtures as fx
from rampstat.sources.numbered_log import NumberedLog, source_files
from rampstat.sources.request_log import ReportBundles

REQUEST_COLS = ["run_id", "seq", "event_id", "ts", "stage_index", "model", "model_percentage",
                "token_index", "token_label", "active_users", "target_rps", "status",
                "status_code", "latency_ms", "error_type", "suite_id", "prompt_id"]


class EventRuns:
    """Tables of the event runs of one data directory, each computed when first asked for
    and stored. The requests come from one ``NumberedLog``: normalised, sorted and numbered
    once, read by every report; stages are looked up when it is read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        self.spark = spark
        self.sf_dir = sf_dir
        self.events = fx.table(spark, sf_dir, "events")
        self.raw = fx.raw_outcomes(self.events)
        self.files: dict | None = None
        self._log: NumberedLog | None = None
        self.bundles: ReportBundles | None = None
        self.bundled: int | None = None  # the log's version that the newest bundle reports
        self._memo: dict = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._memo:
            self._memo[name] = materialize(make(), name)
        return self._memo[name]

    @property
    def users(self) -> DataFrame:
        """Each run's users: the one pass over the log that runs and credentials take."""
        return self._once("users", lambda: fx.run_users(self.raw))

    @property
    def runs(self) -> DataFrame:
        return self._once("runs", lambda: fx.configured_runs(self.users.select("run_id").distinct()))

    @property
    def schedule(self) -> DataFrame:
        """I1 with B17: no more users at a time than a private run has credentials."""
        return self._once("schedule", lambda: cap_users(build_schedule(self.runs), self.runs, self.users))

    @property
    def log(self) -> NumberedLog:
        """The normalised requests, sorted and numbered once."""
        if self._log is None:
            log = NumberedLog(self.spark, scratch_path(self.spark, "numbered-log"))
            log.add(normalize_requests(self.raw))
            self._log = log
        return self._log

    def refresh(self) -> bool:
        """Take in event files that have come since: the log is added to, the rest computed
        anew when asked for. False if files have changed or gone, so that nothing stored holds."""
        now = source_files(self.spark, f"{self.sf_dir.rstrip('/')}/events.parquet")
        if self.files is None:
            self.files = now
        if any(now.get(f) != mark for f, mark in self.files.items()):
            return False
        new = sorted(set(now) - set(self.files))
        if new:
            if self._log is not None:
                self._log.add(normalize_requests(fx.raw_outcomes(self.spark.read.parquet(*new))))
            self.events = fx.table(self.spark, self.sf_dir, "events")
            self.raw = fx.raw_outcomes(self.events)
            self._memo, self.files = {}, now
        return True

    def requests(self, with_seq: bool = True) -> DataFrame:
        """Normalised request rows with stage, users, target
        rate, 1-based sequence number (null without ``with_seq``) and ``prompt_id`` (the stage as text)."""
        key = ("requests", with_seq)
        if key not in self._memo:
            norm = self.log.read(with_seq) if with_seq else self.log.read(False).withColumn("seq", F.lit(None).cast("long"))
            staged = assign_stage(norm, self.schedule, self.runs).withColumn("prompt_id", F.col("stage_index").cast("string"))
            self._memo[key] = staged.select(*REQUEST_COLS)
        return self._memo[key]

    def tokens(self) -> DataFrame:
        return fx.run_tokens(self.users)

    def prompts(self) -> DataFrame:
        return fx.prompts_from_benchmark(fx.table(self.spark, self.sf_dir, "benchmark"))


_KNOWN: dict[tuple, EventRuns] = {}


def event_runs(spark: SparkSession, sf_dir: str) -> EventRuns:
    """The event runs of a directory, shared by all reports of a session while its
    files stay as they are; files that come are added to the stored log."""
    key = (spark, sf_dir.rstrip("/"))
    if key not in _KNOWN or not _KNOWN[key].refresh():
        _KNOWN[key] = EventRuns(spark, sf_dir)
        _KNOWN[key].refresh()
    return _KNOWN[key]


@on_release
def _forget(spark: SparkSession) -> None:
    for key in [k for k in _KNOWN if k[0] is spark]:
        del _KNOWN[key]


class OrderRuns:
    """Tables of the runs that customers configure and orders are the requests of."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        self.runs = fx.order_runs(fx.table(spark, sf_dir, "customer"))
        self.tokens = self.runs.select("run_id", F.posexplode("tokens").alias("token_pos", "t")).select(
            "run_id", F.col("token_pos").cast("long").alias("token_pos"), "t.token", "t.label")
        self.schedule = materialize(cap_users(build_schedule(self.runs), self.runs, self.tokens), "schedule")
        norm = normalize_requests(fx.order_outcomes(fx.table(spark, sf_dir, "orders"), self.schedule))
        self.staged = assign_stage(norm, self.schedule, self.runs)
        self.ends = fx.order_run_ends(self.runs)

    def requests(self) -> DataFrame:
        return with_sequence(self.staged)


def with_ntz(df: DataFrame, cols=("ts",)) -> DataFrame:
    """Driver outputs carry wall-clock timestamps without zone (like the
    source Parquet)."""
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df
