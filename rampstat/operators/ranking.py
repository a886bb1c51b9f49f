"""Ordered running sums without putting a whole group into one task.

``Window.partitionBy(run).orderBy(ts)`` sends every row of a run to a single
task; one run may hold a third of a 100 TB log. Instead we

1. range-partition by (group keys, order keys) - Spark samples the keys, so
   partitions are balanced even when one group dominates;
2. sort within each partition and, in one vectorised pass per partition
   (``mapInArrow``, so nulls and BIGINTs stay what they are), compute the running sums *local* to the partition and
   one total row per (partition, group);
3. turn the small table of totals into per-(partition, group) offsets with a
   window over that table only (its size is partitions + groups);
4. add the offsets back (equi-join on partition id and group keys).

Step 2 is written once as a table in the session's shared checkpoint directory
(``materialize``): the row pass and the totals pass read the same files, so
partition ids (kept as a column) always agree - even if Spark re-plans,
re-samples the range bounds or loses an executor - and the lineage is cut
there. Order keys
must make the order total within a group (e.g. ``ts, event_id``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rampstat.operators.joins import broadcast_if_small
from rampstat.session import materialize

# the functions that tasks run travel with the plan: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PID = "__pid"
_KIND = "__kind"  # 0 = data row, 1 = per-(partition, group) total row


def _range_partition(df: DataFrame, keys: list[str], num_partitions: int | None) -> DataFrame:
    """Range-partition by ``keys``. Without an explicit count Spark uses
    ``spark.sql.shuffle.partitions`` and AQE may coalesce adjacent ranges to
    fit the data size - coalesced partitions stay contiguous, so partition
    ids keep the range order."""
    if num_partitions:
        return df.repartitionByRange(int(num_partitions), *keys)
    return df.repartitionByRange(*keys)


def _same_as_before(a: pa.Array) -> np.ndarray:
    """For each value but the first: equal to the one before, as groups are (null
    equals null, NaN equals NaN)."""
    x, y = a.slice(1), a.slice(0, len(a) - 1)
    same = pc.or_(pc.fill_null(pc.equal(x, y), False), pc.and_(pc.is_null(x), pc.is_null(y)))
    if pa.types.is_floating(a.type):
        same = pc.or_(same, pc.and_(pc.fill_null(pc.is_nan(x), False), pc.fill_null(pc.is_nan(y), False)))
    return same.to_numpy(zero_copy_only=False)


def _same_key(x: tuple, y: tuple) -> bool:
    return all(a == b or (a != a and b != b) for a, b in zip(x, y))


def _tagged(batch: pa.RecordBatch, pid: int, kind: int) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(np.full(n, pid, np.int32)), pa.array(np.full(n, kind, np.int32))],
        names=[*batch.schema.names, _PID, _KIND])


def running_sums(df: DataFrame, group_cols: list[str], order_cols: list[str],
                 values: dict[str, Column | str], num_partitions: int | None = None,
                 with_totals: bool = False) -> DataFrame:
    """Return ``df`` plus one column per entry of ``values``: the running sum
    (ROWS UNBOUNDED PRECEDING .. CURRENT ROW) of that value within the group,
    in the order of ``order_cols``. Values must be whole numbers and are summed
    as BIGINT (a fractional column is refused, not cut). With
    ``with_totals`` each row also gets ``<name>_total``, the group's total
    (taken from the small per-partition totals table, no extra pass)."""
    names = list(values)
    kinds = df.select(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()]).dtypes
    if any(k not in ("tinyint", "smallint", "int", "bigint") for _, k in kinds):
        raise TypeError(f"running sums are of whole numbers: {kinds}")
    tmp = [f"__v{i}" for i in range(len(names))]
    staged = df.select("*", *[
        F.coalesce((F.col(v) if isinstance(v, str) else v).cast("long"), F.lit(0)).alias(t)
        for v, t in zip(values.values(), tmp)])
    keys = group_cols + order_cols
    ranged = _range_partition(staged, keys, num_partitions).sortWithinPartitions(*keys)

    # total rows carry nulls in the payload columns: every field is nullable
    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in staged.schema.fields]
        + [T.StructField(_PID, T.IntegerType()), T.StructField(_KIND, T.IntegerType())])
    gcols = list(group_cols)

    def local_cumsum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry_key = None
        carry = np.zeros(len(tmp), dtype=np.int64)
        ends_of: list[pa.RecordBatch] = []  # the last row of each group of each batch
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # a new group starts where any group column changes (data is sorted)
            change = np.zeros(n, dtype=bool)
            for c in gcols:
                change[1:] |= ~_same_as_before(batch.column(c))
            first = tuple(batch.column(c)[0].as_py() for c in gcols)
            goes_on = carry_key is not None and _same_key(first, carry_key)
            change[0] = True
            starts = np.flatnonzero(change)
            gid = np.cumsum(change) - 1
            sums = []
            for k, t in enumerate(tmp):  # BIGINT without nulls: stays int64
                v = batch.column(t).to_numpy(zero_copy_only=False)
                total = np.cumsum(v)
                base = total[starts] - v[starts]
                base[0] -= carry[k] if goes_on else 0
                sums.append(total - base[gid])
            done = batch
            for t, x in zip(tmp, sums):
                done = done.set_column(done.schema.get_field_index(t), t, pa.array(x, pa.int64()))
            ends = np.r_[starts[1:], n] - 1
            if goes_on:
                ends_of[-1] = ends_of[-1].slice(0, ends_of[-1].num_rows - 1)
            ends_of.append(done.take(pa.array(ends)))
            carry_key = tuple(batch.column(c)[n - 1].as_py() for c in gcols)
            carry = np.array([x[-1] for x in sums], dtype=np.int64)
            yield _tagged(done, pid, 0)
        for last in ends_of:
            cols = [last.column(f) if f in gcols or f in tmp else pa.nulls(last.num_rows, last.schema.field(f).type)
                    for f in last.schema.names]
            yield _tagged(pa.RecordBatch.from_arrays(cols, names=last.schema.names), pid, 1)

    local = materialize(ranged.mapInArrow(local_cumsum, out_schema), "running-sums")

    totals = local.where(F.col(_KIND) == 1).select(_PID, *group_cols, *tmp)
    w = (Window.partitionBy(*group_cols).orderBy(_PID)
         .rowsBetween(Window.unboundedPreceding, -1))
    wall = Window.partitionBy(*group_cols)
    offsets = totals.select(_PID, *group_cols, *[
        F.coalesce(F.sum(t).over(w), F.lit(0)).alias(f"{t}_off") for t in tmp], *[
        F.sum(t).over(wall).alias(f"{t}_tot") for t in tmp])
    rows = local.where(F.col(_KIND) == 0).drop(_KIND)
    o = offsets.select(*[F.col(c).alias(f"__o_{c}") for c in [_PID, *group_cols]],
                       *[f"{t}_off" for t in tmp], *[f"{t}_tot" for t in tmp])
    # at most (partitions + groups) rows: broadcast after its size was measured,
    # so the rows are never shuffled again
    o = broadcast_if_small(o)
    cond = [rows[c].eqNullSafe(o[f"__o_{c}"]) for c in [_PID, *group_cols]]
    joined = rows.join(o, on=cond, how="left")
    result = joined.select(
        *[rows[c] for c in df.columns],
        *[(rows[t] + F.coalesce(o[f"{t}_off"], F.lit(0))).alias(n) for t, n in zip(tmp, names)],
        *([o[f"{t}_tot"].alias(f"{n}_total") for t, n in zip(tmp, names)] if with_totals else []))
    return result


def row_number_in_group(df: DataFrame, group_cols: list[str], order_cols: list[str],
                        name: str = "seq", num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row within its group (F5) - ``row_number()``
    semantics without a single-task window, and without Python: after the
    range shuffle and the sort, ``monotonically_increasing_id()`` numbers the
    rows of each partition in order (partition id in the upper bits); the
    ranged rows are written once (``materialize``), and per-(partition,
    group) first positions and counts give each group's offsets."""
    keys = group_cols + order_cols
    ranged = materialize(_range_partition(df, keys, num_partitions)
                         .sortWithinPartitions(*keys)
                         .withColumn("__mid", F.monotonically_increasing_id()), "row-numbers")
    pid = F.shiftright(F.col("__mid"), 33)
    starts = ranged.groupBy(pid.alias(_PID), *group_cols).agg(
        F.min("__mid").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = broadcast_if_small(starts.select(
        *[F.col(c).alias(f"__o_{c}") for c in [_PID, *group_cols]], "__first",
        F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__off")))
    rows = ranged.withColumn(_PID, pid)
    cond = [rows[c].eqNullSafe(offsets[f"__o_{c}"]) for c in [_PID, *group_cols]]
    j = rows.join(offsets, cond, "left")
    return j.select(*[rows[c] for c in df.columns],
                    (F.col("__off") + F.col("__mid") - F.col("__first") + 1).cast("long").alias(name))


def previous_in_group(df: DataFrame, group_cols: list[str], order_cols: list[str], value: str,
                      name: str = "previous", num_partitions: int | None = None) -> DataFrame:
    """``df`` plus the ``value`` of the row before in the group (``lag``), null for the first
    row of a group. The rows are range-partitioned and sorted once; what lies in
    the partition before is patched from one row per (partition, group)."""
    keys = group_cols + order_cols
    staged = df.withColumns({"__prev": F.col(value), "__head": F.lit(False)})
    ranged = _range_partition(staged, keys, num_partitions).sortWithinPartitions(*keys)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in staged.schema.fields]
                          + [T.StructField(_PID, T.IntegerType()), T.StructField(_KIND, T.IntegerType())])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        last, ends_of = None, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            change = np.zeros(n, dtype=bool)
            for c in group_cols:
                change[1:] |= ~_same_as_before(batch.column(c))
            goes_on = last is not None and _same_key(tuple(batch.column(c)[0].as_py() for c in group_cols),
                                                     tuple(last.column(c)[0].as_py() for c in group_cols))
            change[0] = not goes_on
            own = batch.column(value)
            before = last.column(value) if goes_on else pa.nulls(1, own.type)
            prev = pc.if_else(pa.array(~change), pa.concat_arrays([before, own.slice(0, n - 1)]), pa.scalar(None, own.type))
            names = batch.schema.names
            done = batch.set_column(names.index("__prev"), "__prev", prev).set_column(names.index("__head"), "__head", pa.array(change))
            starts = np.flatnonzero(change)
            ends = np.unique(np.r_[starts[starts > 0] - 1, n - 1])
            if goes_on:
                ends_of.pop()
            ends_of += [batch.slice(int(i), 1) for i in ends]
            last = batch.slice(n - 1, 1)
            yield _tagged(done, pid, 0)
        for row in ends_of:
            cols = [row.column(f) if f in group_cols or f == value else pa.nulls(1, row.schema.field(f).type) for f in row.schema.names]
            yield _tagged(pa.RecordBatch.from_arrays(cols, names=row.schema.names), pid, 1)

    local = materialize(ranged.mapInArrow(shift, schema), "previous")
    w = Window.partitionBy(*group_cols).orderBy(_PID)
    patch = broadcast_if_small(local.where(F.col(_KIND) == 1).select(
        *[F.col(c).alias(f"__o_{c}") for c in [_PID, *group_cols]], F.lag(value).over(w).alias("__from")))
    rows = local.where(F.col(_KIND) == 0)
    on = [rows["__head"]] + [rows[c].eqNullSafe(patch[f"__o_{c}"]) for c in [_PID, *group_cols]]
    return rows.join(patch, on, "left").select(
        *[rows[c] for c in df.columns], F.when(rows["__head"], F.col("__from")).otherwise(rows["__prev"]).alias(name))
