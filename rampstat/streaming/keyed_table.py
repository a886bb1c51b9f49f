"""A table of one row per key that a stream keeps up to date by what has changed.

A micro-batch writes the rows of its changed keys as a *delta* of its own; nothing else is
touched. From time to time the deltas are folded into a new *base*: when they hold
as many rows as the base, so a row is rewritten a bounded number of times for
each change, whatever the number of batches. Each batch ends with a *manifest*, a small
table that names the base and the deltas that make up the version; readers take
the newest manifest, so they see all of a version or none of it, and older versions stay
readable for a while.

How rows of one key become one: columns named in ``sums`` are added up (batches that bring
increments), those in ``newest`` keep their largest value and those in ``sketches`` are merged
as KLL sketches; without any of these the row of the
latest batch replaces earlier ones (update mode). ``ordered_by`` keeps the whole row whose
columns of that name are largest.

A batch that runs again after a restart finds its own manifest and does nothing, or
writes its delta anew. A table whose earlier versions are gone, or that another stream
has written, is an error: counting on from nothing would be wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions that stay for readers of an older one.
KEPT_VERSIONS = 10
#: Rows of deltas that are left alone, whatever the size of the base, and their number at most.
LEAST_ROWS, MOST_DELTAS = 10_000, 50

_MANIFEST = "version long, stream string, base long, base_rows long, deltas array<long>, delta_rows long"


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: list[str] = (), newest: list[str] = (),
                 ordered_by: list[str] = (), stream: str = "", least_rows: int = LEAST_ROWS, sketches: list[str] = ()):
        """``stream``: what writes the table, the query's checkpoint folder for instance."""
        self.spark, self.path, self.keys, self.stream = spark, path.rstrip("/"), list(keys), stream
        self.sums, self.newest, self.ordered_by, self.least_rows = list(sums), list(newest), list(ordered_by), least_rows
        self.sketches = list(sketches)

    # -- versions

    def _versions(self) -> list[int]:
        at, fs = _fs(self.spark, f"{self.path}/manifests/version=*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(at) or [])

    def _manifest(self, version: int):
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests/version={version:012d}").first()

    def versions(self) -> list[int]:
        return self._versions()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that is still kept."""
        known = self._versions()
        if not known:
            raise FileNotFoundError(f"no finished version under {self.path}")
        return self._rows(self._manifest(known[-1] if version is None else version))

    def _rows(self, m) -> DataFrame:
        folders = ([f"{self.path}/base/version={m.base:012d}"] if m.base is not None else []) + [f"{self.path}/deltas/batch={d:012d}" for d in m.deltas]
        # partition columns of the folders' names would read back as data
        parts = [self.spark.read.parquet(f).withColumn("_version", F.lit(i)) for i, f in enumerate(folders)]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return self._merged(both)

    def _merged(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys and c != "_version"]
        if self.sums or self.newest or self.sketches:
            return rows.groupBy(*self.keys).agg(*[F.sum(c).alias(c) for c in self.sums], *[F.max(c).alias(c) for c in self.newest],
                                                *[F.kll_merge_agg_double(c).alias(c) for c in self.sketches]).select(*self.keys, *rest)
        by = F.struct(*self.ordered_by) if self.ordered_by else F.col("_version")
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(*self.keys, "_row.*")

    # -- writing

    def _before(self, epoch: int):
        """The manifest that this batch follows; None for a stream's first batch."""
        known = [v for v in self._versions() if v < epoch]
        if epoch and (not known or known[-1] != epoch - 1):
            raise LookupError(f"{self.path} lacks what batch {epoch - 1} published: the folder is new, or was cleaned, "
                              "but the checkpoint is not; start both anew, or bring the folder back")
        m = self._manifest(known[-1]) if known else None
        if m is not None and m.stream != self.stream:
            raise LookupError(f"{self.path} is the table of another stream: {m.stream}")
        return m

    def publish(self, batch: DataFrame, epoch: int) -> None:
        """A ``foreachBatch`` writer."""
        if epoch in self._versions():
            if self._manifest(epoch).stream != self.stream:
                raise LookupError(f"{self.path} is the table of another stream")
            return
        before = self._before(epoch)
        delta = f"{self.path}/deltas/batch={epoch:012d}"
        batch.write.mode("overwrite").parquet(delta)
        rows = self.spark.read.parquet(delta).count()  # from the files' footers
        base, base_rows, deltas, delta_rows = (before.base, before.base_rows, list(before.deltas), before.delta_rows) if before else (None, 0, [], 0)
        deltas, delta_rows = [*deltas, epoch], delta_rows + rows
        if rows == 0 and len(deltas) > 1:
            deltas = deltas[:-1]
        if delta_rows >= max(base_rows, self.least_rows) or len(deltas) > MOST_DELTAS:
            whole = self._rows(_Of(base, deltas))
            whole.write.mode("overwrite").parquet(f"{self.path}/base/version={epoch:012d}")
            base, deltas, delta_rows = epoch, [], 0
            base_rows = self.spark.read.parquet(f"{self.path}/base/version={epoch:012d}").count()
        made = self.spark.createDataFrame([(epoch, self.stream, base, base_rows, deltas, delta_rows)], _MANIFEST).coalesce(1)
        made.write.mode("overwrite").parquet(f"{self.path}/manifests/version={epoch:012d}")
        self._clean()

    def _clean(self) -> None:
        """Delete what no kept version reads."""
        known = self._versions()
        kept = [self._manifest(v) for v in known[-KEPT_VERSIONS:]]
        used = {f"base/version={m.base:012d}" for m in kept if m.base is not None} | {f"deltas/batch={d:012d}" for m in kept for d in m.deltas}
        used |= {f"manifests/version={v:012d}" for v in known[-KEPT_VERSIONS:]}
        if len(known) <= KEPT_VERSIONS:
            return
        for kind in ("manifests", "base", "deltas"):
            at, fs = _fs(self.spark, f"{self.path}/{kind}/*=*")
            for s in fs.globStatus(at) or []:
                if f"{kind}/{s.getPath().getName()}" not in used:
                    fs.delete(s.getPath(), True)


class _Of:
    def __init__(self, base, deltas):
        self.base, self.deltas = base, deltas
