"""F5 stored: a request log whose rows keep their place in their run, kept up to date file
by file.

A log is a folder of *segments* and an *index*. Rows that come in are range-partitioned and
sorted by (run, order keys) once and stored as a segment; each row keeps its number within
the task that wrote it. The index holds *entries*: a run's rows of one task of one segment
that lie side by side, with their count, first and last key. The entries of a run never
overlap, so a row's number in its run is the counts of the run's earlier entries, and
its own place in its entry: reading numbers a join with the index (a few rows per task
and run), not a sort.

New rows that come after all others of their run, or between two entries, are
entries of their own. Where new rows fall *inside* an entry (late rows), the rows of that
entry alone are read, sorted again together with them, and stored with the new segment;
the index no longer names the old entry. No other row is moved or read.

Each version of the index is a table of its own, written after its segment, so readers see a
version whole or not at all and an ``add`` that failed leaves nothing that counts. Of
rows whose order keys are equal any may come first. A null run is a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rampstat.operators.joins import broadcast_if_small

_ENTRY = ["_segment", "_part", "_code"]


class NumberedLog:
    def __init__(self, spark: SparkSession, path: str, group: str = "run_id", order: tuple[str, ...] = ("ts", "event_id"),
                 num_partitions: int | None = None):
        self.spark, self.path, self.group, self.order = spark, path.rstrip("/"), group, list(order)
        self.num_partitions = num_partitions
        self.version = max(self._versions(), default=-1)
        #: Entries that were sorted again, so far: their old rows still lie in their segments.
        self.resorted = 0 if self.version < 0 else self.index().agg(F.max("resorted")).first()[0] or 0

    def _versions(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/index/version=*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
        return [int(s.getPath().getParent().getName().split("=")[1]) for s in found]

    def index(self) -> DataFrame:
        """The entries: ``_segment``, ``_part``, ``_code``, the run, ``first_mid``, ``n``, first and last key."""
        return self.spark.read.parquet(f"{self.path}/index/version={self.version:06d}")

    def _stored(self) -> DataFrame:
        rows = self.spark.read.option("basePath", f"{self.path}/segments").parquet(
            *[f"{self.path}/segments/_segment={s}" for s in range(self.version + 1)])
        return rows.withColumn("_part", F.shiftright("_mid", 33).cast("long")).withColumn("_segment", F.col("_segment").cast("long"))

    def _same_entry(self, rows: DataFrame, entries: DataFrame):
        on = rows[self.group].eqNullSafe(entries["_run"])
        for c in _ENTRY:
            on &= rows[c] == entries[f"_e{c}"]
        return on

    def _named(self, entries: DataFrame, *more) -> DataFrame:
        return entries.select(F.col(self.group).alias("_run"), *[F.col(c).alias(f"_e{c}") for c in _ENTRY], *more)

    # -- adding

    def _placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_code``, their place among the entries of their run: 2 p inside the p-th
        (from 1), 2 p + 1 after it; and ``_entry``, the one they lie in."""
        key = F.struct(*self.order)
        if self.version < 0:
            return rows.withColumn("_code", F.lit(1).cast("long"))
        entry = F.struct("first", "last", *_ENTRY)
        of = broadcast_if_small(self.index().groupBy(F.col(self.group).alias("_run")).agg(
            F.array_sort(F.collect_list(entry)).alias("_entries"), F.max("last").alias("_end")))
        j = rows.join(of, rows[self.group].eqNullSafe(of["_run"]), "left").withColumn("_key", key)
        # nearly all rows come after all that is stored
        place = F.expr("CASE WHEN _entries IS NULL THEN 0 WHEN _key > _end THEN size(_entries) ELSE size(filter(_entries, e -> e.first <= _key)) END")
        j = j.withColumn("_p", place).withColumn("_entry", F.expr("CASE WHEN _p > 0 AND _key <= _entries[_p - 1].last THEN _entries[_p - 1] END"))
        code = F.expr("CAST(2 * _p + IF(_entry IS NULL, 1, 0) AS BIGINT)")
        return j.select(*rows.columns, code.alias("_code"), F.struct(*[F.col(f"_entry.{c}").alias(c) for c in _ENTRY]).alias("_entry"))

    def add(self, rows: DataFrame) -> int:
        """Store new rows as a segment; returns its number."""
        columns, segment = rows.columns, self.version + 1
        placed = self._placed(rows)
        hit = None
        if segment:
            inside = placed.where(F.col("_entry._part").isNotNull())
            hit = inside.select(F.col(self.group).alias("_run"), *[F.col(f"_entry.{c}").alias(f"_e{c}") for c in _ENTRY], F.col("_code").alias("_new")).distinct()
            hit = broadcast_if_small(hit)
            n_hit = hit.count()
            placed = placed.drop("_entry")
            if n_hit:
                old = self._stored()
                again = old.join(hit, self._same_entry(old, hit)).select(*columns, F.col("_new").alias("_code"))
                placed = placed.unionByName(again)
            self.resorted += n_hit
        keys = [self.group, "_code", *self.order]
        ranged = placed.repartitionByRange(int(self.num_partitions), *keys) if self.num_partitions else placed.repartitionByRange(*keys)
        at = f"{self.path}/segments/_segment={segment}"
        ranged.sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id()).write.mode("overwrite").parquet(at)
        key = F.struct(*self.order)
        new = self.spark.read.parquet(at).groupBy(F.shiftright("_mid", 33).cast("long").alias("_part"), self.group, "_code").agg(
            F.min("_mid").alias("first_mid"), F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
        new = new.withColumn("_segment", F.lit(segment).cast("long"))
        if segment:
            old = self.index().drop("resorted")
            new = old.join(hit, self._same_entry(old, hit), "left_anti").unionByName(new)
        new.withColumn("resorted", F.lit(self.resorted)).write.mode("overwrite").parquet(f"{self.path}/index/version={segment:06d}")
        self.version = segment
        return segment

    # -- reading

    def read(self, numbered: bool = True, name: str = "seq") -> DataFrame:
        """All rows, with ``name``, the 1-based number of each in its run. Without it the
        index is needed only if entries were sorted again."""
        rows = self._stored()
        own = [c for c in rows.columns if c not in (*_ENTRY, "_mid")]
        if not numbered and not self.resorted:
            return rows.select(*own)
        w = Window.partitionBy(self.group).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # over the index alone
        entries = broadcast_if_small(self._named(self.index().withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))), "first_mid", "_before"))
        j = rows.join(entries, self._same_entry(rows, entries))
        if not numbered:
            return j.select(*[rows[c] for c in own])
        return j.select(*[rows[c] for c in own], (F.col("_before") + rows["_mid"] - F.col("first_mid") + 1).cast("long").alias(name))


def source_files(spark: SparkSession, path: str) -> dict[str, tuple]:
    """The Parquet files of a table, with what tells whether one has changed; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return {r.path: (r.length, r.modificationTime) for r in found.select("path", "length", "modificationTime").collect()}
