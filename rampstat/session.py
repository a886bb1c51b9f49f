"""Session helpers: one place for the settings every job here relies on."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

# Settings the operators assume. Session time zone must be UTC: request
# timestamps are compared against stage slots in epoch microseconds.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "rampstat", extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, pass the cluster's own session instead."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session settings the operators depend on and make sure a
    reliable checkpoint directory exists (used to cut lineage)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory of this session.

    The cluster names it in ``spark.checkpoint.dir``; we only choose our own
    (a fresh local scratch folder) when nothing is configured, as in tests.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if not configured:
        # only a local session may make its own folder: executors of a cluster
        # would each write to their own disk
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="rampstat-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


_WRITTEN: list[tuple[SparkSession, str]] = []
_ON_RELEASE: list[Callable[[SparkSession], None]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared checkpoint directory; ``release`` deletes what lies there."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/rampstat/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df, name: str = "stage"):
    """Compute ``df`` once: written as a Parquet table in the session's shared
    checkpoint directory and read back, so the lineage is cut, lost executors
    cost nothing, and the rows are stored once. ``release`` deletes the tables."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def on_release(forget: Callable[[SparkSession], None]) -> Callable[[SparkSession], None]:
    """Register what must forget a session's tables when they are released."""
    _ON_RELEASE.append(forget)
    return forget


def release(spark: SparkSession) -> int:
    """Delete what this session has stored - tables, logs, bundles, stream folders (call
    it when their results have been used); returns how many."""
    own = [path for s, path in _WRITTEN if s is spark]
    _WRITTEN[:] = [x for x in _WRITTEN if x[0] is not spark]
    for forget in _ON_RELEASE:
        forget(spark)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in own:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(own)
