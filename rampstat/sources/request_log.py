"""A1 request-log source and A7-A11 report sinks.

The request log is read with an explicit schema (no inference) and written
partitioned by ``run_id`` so per-run reports prune partitions. The report
bundle is five datasets under one root - ``config``, ``stage_summary``,
``model_summary``, ``raw_requests``, ``errors`` - written in that order, each
partitioned by run, and the chart series (A10) after them; ``ReportBundles`` commits them as one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rampstat.schema import REQUEST

# The bundle's tables, in their order.
BUNDLE_PARTS = ["config", "stage_summary", "model_summary", "raw_requests", "errors"]


def read_request_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: the rows every aggregate reads (parquet, json or csv)."""
    reader = spark.read.schema(REQUEST)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def write_request_log(requests: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Materialise a normalised log, one directory per run (partition
    pruning for per-run reports; pushed-down filters on stored columns)."""
    by_run(requests).write.mode(mode).partitionBy("run_id").parquet(path)


def empty_like(spark: SparkSession, schema) -> DataFrame:
    """An empty result is a typed empty DataFrame (header only), never
    a padded row."""
    return spark.createDataFrame([], schema)


def write_report_bundle(root: str, parts: dict[str, DataFrame], mode: str = "overwrite",
                        fmt: str = "parquet") -> list[str]:
    """Write the report datasets in bundle order under ``root``;
    returns the written paths. Rows are brought together by run before they are
    written (a hot run is spread over several files), so a run has a few files, not one per
    task. Parts without a ``run_id`` column are written unpartitioned."""
    written = []
    for name in BUNDLE_PARTS + [p for p in parts if p not in BUNDLE_PARTS]:
        if name not in parts:
            continue
        df = by_run(parts[name])
        w = df.write.mode(mode).format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")
        if "run_id" in df.columns:
            w = w.partitionBy("run_id")
        path = f"{root.rstrip('/')}/{name}"
        w.save(path)
        written.append(path)
    return written


def by_run(df: DataFrame, run_col: str = "run_id") -> DataFrame:
    """``df`` dealt out for a write that is partitioned by run: a task holds whole runs where
    they are small, and a large run is split over tasks as its size asks (rebalance)."""
    return df.hint("rebalance", F.col(run_col)) if run_col in df.columns else df


class ReportBundles:
    """Bundles under one root, each a version: its tables lie in a folder of their own, and a
    manifest, written last, names them all. Readers take the tables that one manifest names, so
    they see the five tables of one write or none of them. Old versions are deleted, all
    but the last ``keep`` that a reader may still hold."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, pattern: str) -> list[str]:
        at, fs = self._fs(f"{self.root}/{pattern}")
        return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])

    def versions(self) -> list[int]:
        return [int(p.split("manifest=")[1].split("/")[0]) for p in self._names("manifest=*/_SUCCESS")]

    def commit(self, parts: dict[str, DataFrame], unit: str = "rps") -> int:
        """Write a bundle; returns its version. One that fails before its manifest is no version."""
        used = [int(p.rsplit("=", 1)[1]) for p in self._names("bundle=*")]
        version = max([*self.versions(), *used], default=-1) + 1
        folder = f"{self.root}/bundle={version:06d}"
        written = write_report_bundle(folder, parts)
        rows = [(name, f"bundle={version:06d}/{name}", parts[name].schema.json(), unit) for name in (p.rsplit("/", 1)[1] for p in written)]
        manifest = self.spark.createDataFrame(rows, "part string, path string, schema string, unit string").coalesce(1)
        manifest.write.parquet(f"{self.root}/manifest={version:06d}")
        self.release()
        return version

    def parts(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of the newest bundle, or of an older one that is still kept, with the columns
        and types that they were written with."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"no such bundle under {self.root}")
        version = known[-1] if version is None else version
        named = self.spark.read.parquet(f"{self.root}/manifest={version:06d}").collect()  # a row per table
        out = {}
        for r in named:
            schema = StructType.fromJson(json.loads(r.schema))
            out[r.part] = self.spark.read.schema(schema).parquet(f"{self.root}/{r.path}").select(*schema.names)
        return {p: out[p] for p in [*BUNDLE_PARTS, *out] if p in out}

    def release(self) -> None:
        """Delete all but the last ``keep`` versions, and what failed writes have left before them."""
        kept = self.versions()[-self.keep:]
        for path in [*self._names("manifest=*"), *self._names("bundle=*")]:
            if kept and int(path.rsplit("=", 1)[1]) < kept[0]:
                at, fs = self._fs(path)
                fs.delete(at, True)


def stage_report(stages: DataFrame, unit: str = "rps") -> DataFrame:
    """Stage sheet - rates in ``unit`` rounded to 4 digits."""
    from rampstat.functions.rates import column_suffix, report_round, rps_to_display
    sfx = column_suffix(unit)
    return stages.select(
        "run_id", "stage_index", "elapsed_seconds",
        report_round(rps_to_display(F.col("target_rps"), unit), 4).alias(f"target_{sfx}"),
        report_round(rps_to_display(F.col("achieved_rps"), unit), 4).alias(f"achieved_{sfx}"),
        "active_users", "total_requests", "successful", "failed", "avg_latency_ms",
        "p50_latency_ms", "p95_latency_ms", "p99_latency_ms", "error_rate")
