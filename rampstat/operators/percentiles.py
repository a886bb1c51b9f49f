"""Floor-rank percentiles - the value at 0-based rank ``floor(n*P/100)``
of the ascending latencies, with no interpolation.

Forms (all exact except ``approx``):

* ``histogram`` (default): count latencies per (group, value) - map-side
  combined, so repeated values (e.g. the 0.0 of every timeout) collapse
  before the shuffle - then running counts over the value order via
  ``running_sums`` (range-partitioned, no group ever sits in one task), and
  pick the first value whose running count exceeds the rank. Integer rank
  arithmetic ``n*P div 100`` is exact for any n.
* ``disc``: numbers the rows of each group in value order
  (``row_number_in_group``, range-partitioned) and picks the row at the rank:
  integer arithmetic too, exact at every size.
* ``approx``: ``percentile_approx``; standard rank and inexact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rampstat.operators.joins import broadcast_if_small
from rampstat.operators.ranking import row_number_in_group, running_sums

PCTS = (50, 95, 99)
# 1 - P/100 written as exact decimal literals for the DESC form.
_COMPLEMENT = {50: "0.5", 95: "0.05", 99: "0.01"}


def pct_name(p: int, value_col: str = "latency_ms") -> str:
    base = value_col[:-3] if value_col.endswith("_ms") else value_col
    return f"p{p}_{base}_ms" if value_col.endswith("_ms") else f"p{p}_{value_col}"


def histogram(df: DataFrame, group_cols: list[str], value_col: str,
              extra: dict[str, Column] | None = None) -> DataFrame:
    """(group..., value, c, extra sums...) - the per-value counts E2 works on."""
    aggs = [F.count("*").alias("c")]
    for name, col in (extra or {}).items():
        aggs.append(F.sum(col).alias(name))
    return df.groupBy(*group_cols, value_col).agg(*aggs)


def percentile_aggs(pcts, names, value_col: str, cum: str = "_cum", n: str = "_cum_total"):
    """Aggregates picking, per group, the first value whose running count
    exceeds the floor rank ``n*P div 100`` (exact integer arithmetic)."""
    return [F.min(F.when(F.col(cum) > F.expr(f"{n} * {int(p)} div 100"), F.col(value_col))).alias(name)
            for p, name in zip(pcts, names)]


def percentiles_from_histogram(hist: DataFrame, group_cols: list[str], value_col: str,
                               pcts=PCTS, names: list[str] | None = None,
                               num_partitions: int | None = None) -> DataFrame:
    """Floor-rank percentiles from a (group, value, c) histogram: one
    range-partitioned running count (carrying group totals), then one
    partially aggregated group-by."""
    names = names or [pct_name(p, value_col) for p in pcts]
    cum = running_sums(hist, group_cols, [value_col], {"_cum": "c"}, num_partitions,
                       with_totals=True)
    return cum.groupBy(*group_cols).agg(*percentile_aggs(pcts, names, value_col))


def floor_rank_percentiles(df: DataFrame, group_cols: list[str], value_col: str = "latency_ms",
                           pcts=PCTS, method: str = "histogram",
                           names: list[str] | None = None) -> DataFrame:
    names = names or [pct_name(p, value_col) for p in pcts]
    if method == "histogram":
        return percentiles_from_histogram(histogram(df, group_cols, value_col), group_cols,
                                          value_col, pcts, names)
    if method == "disc":
        rows = df.select(*group_cols, value_col)
        placed = row_number_in_group(rows, group_cols, [value_col], name="_pos")
        sizes = broadcast_if_small(rows.groupBy(*group_cols).agg(F.count("*").alias("_n")))
        on = [placed[c].eqNullSafe(sizes[c]) for c in group_cols]
        j = placed.join(sizes, on).select(*[placed[c] for c in group_cols], value_col, "_pos", "_n")
        return j.groupBy(*group_cols).agg(*[
            F.max(F.when(F.col("_pos") - 1 == F.expr(f"_n * {int(p)} div 100"), F.col(value_col))).alias(n)
            for p, n in zip(pcts, names)])
    if method == "approx":
        return df.groupBy(*group_cols).agg(*[
            F.percentile_approx(value_col, p / 100.0).cast("double").alias(n)
            for p, n in zip(pcts, names)])
    raise ValueError(f"unknown percentile method {method!r}")


def disc_expr(value_col: str, p: int) -> Column:
    """Floor-rank percentile as one aggregate expression: its state holds a group's
    distinct values and its rank is a float, so for bounded groups (a micro-batch,
    a small run) of up to about 300,000 rows."""
    if p in _COMPLEMENT:
        q = _COMPLEMENT[p]
    else:
        q = repr((100 - p) / 100)
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value_col} DESC)").cast("double")


def disc_or_approx(value_col: str, p: int, method: str) -> Column:
    if method == "disc":
        return disc_expr(value_col, p)
    if method == "approx":
        return F.percentile_approx(value_col, p / 100.0).cast("double")
    raise ValueError(f"unknown percentile method {method!r}")


#: ``percentile_approx`` keeps this many values: its rank is off by n / ACCURACY at most.
ACCURACY = 10000


def approx_rank_error(df: DataFrame, group_cols: list[str], value_col: str = "latency_ms", pcts=PCTS) -> DataFrame:
    """Per group: ``n``, and for each percentile whether the approximate value's rank
    is within n / ACCURACY (and one) of the floor rank - the bound it promises."""
    approx = df.groupBy(*group_cols).agg(F.count("*").alias("n"), *[
        F.percentile_approx(value_col, p / 100.0, ACCURACY).alias(f"_v{p}") for p in pcts])
    a = broadcast_if_small(approx)
    j = df.select(*group_cols, value_col).join(a, [df[c].eqNullSafe(a[c]) for c in group_cols])
    ranks = j.groupBy(*[a[c] for c in group_cols], "n").agg(*[
        e for p in pcts for e in (F.sum((df[value_col] < F.col(f"_v{p}")).cast("long")).alias(f"_lo{p}"),
                                  F.sum((df[value_col] <= F.col(f"_v{p}")).cast("long")).alias(f"_hi{p}"))])
    slack = F.col("n") / ACCURACY + 1
    return ranks.select(*group_cols, "n", *[
        ((F.col(f"_lo{p}") <= F.expr(f"n * {p} div 100") + slack) & (F.col(f"_hi{p}") >= F.expr(f"n * {p} div 100") - slack)).alias(f"p{p}_within")
        for p in pcts])
