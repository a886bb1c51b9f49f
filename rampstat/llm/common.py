"""Helpers shared by the operators: scratch tables, id handling, text splitting.

Every operator first picks the columns it needs under names of its own, so
extra input columns, whatever they are called, cannot clash with its work.
"""

from __future__ import annotations

import string
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the bytes 0x20 and 0x09 to 0x0D.
SPACE = " \t\n\x0b\x0c\r"

#: A document without an id takes part as the one with the largest id.
NO_ID = 2**63 - 1


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; executors of a cluster
    would not see a folder of the driver's machine, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the scratch folder; ``release`` deletes what lies there."""
    path = f"{scratch_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def release(spark: SparkSession) -> int:
    """Delete this session's intermediate tables and archives, once the results that
    read them have been written elsewhere; returns how many."""
    own = [path for s, path in _WRITTEN if s is spark]
    _WRITTEN[:] = [x for x in _WRITTEN if x[0] is not spark]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in own:
        at = hadoop.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(own)


#: Bytes of a batch that Spark hands to Python, about.
BATCH_BYTES = "8m"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application: they
    need not share the driver's folders or start in the same one. Also bounds the
    batches that Python gets: long texts would make them large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("64m", "64MB", str(64 << 20), f"{64 << 20}b"):  # not set by the user
        spark.conf.set(key, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        top = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="llm-ship-"), f"{top.name}_code.zip")
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(str(to))


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back:
    computed once, lineage cut, and readable after executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_id(c: Column) -> Column:
    """The id as a long, null as the largest one."""
    return F.coalesce(c.cast("long"), F.lit(NO_ID))


def given_id(c: Column) -> Column:
    """Back from ``known_id``."""
    return F.when(c != NO_ID, c)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def digest(c: Column) -> Column:
    """128 bits that stand for a text in joins and groups."""
    return F.unhex(F.md5(c.cast("binary")))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. ``lower`` does just that wherever every other
    character is ASCII, a lower-case letter or a letter without case; the rest
    takes one ``replace`` for each letter, still far faster than ``translate``."""
    plain = (F.octet_length(c) == F.char_length(c)) | ~F.rlike(c, F.lit(r"[^\x00-\x7F\p{Ll}\p{Lo}]"))
    slow = c
    for x in string.ascii_uppercase:
        slow = F.replace(slow, F.lit(x), F.lit(x.lower()))
    return F.when(plain, F.lower(c)).otherwise(slow)


def hash128(c: Column) -> list[Column]:
    """Two longs that stand for a text in joins and groups; never null."""
    return [F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(1), c).alias("h2")]


def broadcast_below(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only when ``df`` was counted and has at most ``rows``
    rows; else ``df``, to be joined by shuffle. ``df`` should be cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df
