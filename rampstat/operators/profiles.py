"""Latency profiles that are kept up to date (E1, E3, E4, E16) and sketches that merge.

``ProfileStore`` holds a histogram per (run, stage, model, latency) as a ``KeyedTable``: new
requests add their counts, nothing else is read or written, and every profile - counts,
mean and exact floor-rank percentiles, by any of the grains - comes from the stored counts.
Adding in steps gives what one pass over all requests gives.

``latency_sketches`` keeps a KLL sketch per group instead: a few kilobytes for any number of
requests. Sketches of parts (batches, stages, models) merge into that of the whole,
in any order and number, with the same bound on the error of a rank. Values are those of
requests, not interpolated; which of those near the rank is left to chance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.operators.aggregate import PCT_COLS, profile_from_histogram, rollup_histogram
from rampstat.operators.joins import broadcast_if_small
from rampstat.operators.percentiles import PCTS
from rampstat.streaming.keyed_table import KeyedTable

KEYS = ["run_id", "stage_index", "model", "latency_ms"]
#: Size of a KLL sketch: its rank is off by about 2.446 / K ** 0.9433 of n (99 of 100 times).
KLL_K = 800
#: The share of n that a sketch's rank may be off: twice that figure, over five standard deviations.
KLL_ERROR = 2 * 2.446 / KLL_K ** 0.9433


def request_histogram(requests: DataFrame) -> DataFrame:
    """Requests and successes per (run, stage, model, latency), combined before the shuffle."""
    ok = (F.col("status") == "success").cast("long")
    return requests.groupBy(*KEYS).agg(F.count("*").alias("c"), F.sum(ok).alias("_ok"))


class ProfileStore:
    """The histogram of a growing log. ``add`` is given each request once; a number that was
    added before (a batch that runs again) is left out."""

    def __init__(self, spark: SparkSession, path: str, source: str = ""):
        self.table = KeyedTable(spark, path, KEYS, sums=["c", "_ok"], stream=source)

    def add(self, requests: DataFrame, number: int) -> None:
        self.table.publish(request_histogram(requests), number)

    def histogram(self) -> DataFrame:
        return self.table.read()

    def profiles(self, group_cols: list[str]) -> DataFrame:
        """Counts, mean and percentiles by some of run, stage and model."""
        hist = self.histogram().groupBy(*group_cols, "latency_ms").agg(F.sum("c").alias("c"), F.sum("_ok").alias("_ok"))
        return profile_from_histogram(hist, group_cols)

    def rollup(self) -> DataFrame:
        """All three grains."""
        return profile_from_histogram(rollup_histogram(self.histogram()), ["grain", "run_id", "stage_index", "model"])


def latency_sketches(requests: DataFrame, group_cols: list[str], value_col: str = "latency_ms", k: int = KLL_K) -> DataFrame:
    """A KLL sketch of each group, ``sketch``; merged per task before the shuffle."""
    return requests.groupBy(*group_cols).agg(F.kll_sketch_agg_double(value_col, F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, group_cols: list[str]) -> DataFrame:
    """Sketches of finer groups or of batches merged into those of ``group_cols``."""
    return sketches.groupBy(*group_cols).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_percentiles(sketches: DataFrame, group_cols: list[str], pcts=PCTS, names: list[str] | None = None) -> DataFrame:
    """``n`` and the percentiles of each group's sketch."""
    return sketches.select(*group_cols, F.kll_sketch_get_n_double("sketch").alias("n"), *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0)).alias(name) for p, name in zip(pcts, names or PCT_COLS)])


def sketch_rank_error(requests: DataFrame, sketches: DataFrame, group_cols: list[str], value_col: str = "latency_ms", pcts=PCTS,
                      error: float = KLL_ERROR) -> DataFrame:
    """Per group: ``n``, and whether each sketched percentile's exact rank among the requests
    is within ``error`` of n (and one) of the floor rank."""
    v = [f"_v{p}" for p in pcts]
    told = broadcast_if_small(sketched_percentiles(sketches, group_cols, pcts, v).select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], "n", *v))
    on = requests[group_cols[0]].eqNullSafe(told[f"_g_{group_cols[0]}"])
    for c in group_cols[1:]:
        on &= requests[c].eqNullSafe(told[f"_g_{c}"])
    j = requests.select(*group_cols, value_col).join(told, on)
    x = F.col(value_col)
    ranks = j.groupBy(*group_cols, "n").agg(*[e for p in pcts for e in (
        F.sum((x < F.col(f"_v{p}")).cast("long")).alias(f"_lo{p}"), F.sum((x <= F.col(f"_v{p}")).cast("long")).alias(f"_hi{p}"))])
    slack = F.col("n") * error + 1
    return ranks.select(*group_cols, "n", *[
        ((F.col(f"_lo{p}") <= F.expr(f"n * {p} div 100") + slack) & (F.col(f"_hi{p}") >= F.expr(f"n * {p} div 100") - slack)).alias(f"p{p}_within")
        for p in pcts])
