"""Sharding by extendible hashing: documents into shards under a byte limit.

A document's key is a 60-bit hash. The directory begins with one bucket of all
documents; a bucket over the limit splits on the next bit of the hash, and only
those buckets split, until each fits. A shard is a bucket: a prefix of hash
bits, whose length is its local depth.

The first splits are found from one histogram of bytes by the leading
``cell_bits`` bits, which is a few times the number of shards; the rollup of
that histogram to every shorter prefix gives, for each cell, the shortest
prefix that fits. Cells that are themselves over the limit go round again, with
their own documents only and the next ``cell_bits`` bits. Rows that share id and
text hash alike to the last bit and could never be split; they continue on a
hash of their row number in the written table, so even one document repeated
without end is spread. What is left over the limit is a single document, alone.

Only the hash table (id, hash, bytes) is shuffled, partly aggregated first, and
directory cells; texts are not moved to find the shards.

Defined cases: a null text has no bytes, a null id hashes as null; the empty table
gives no rows; repeated rows are spread as above; a text longer than the limit is
a shard of its own, marked ``oversized``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.common import broadcast_below, save, table, text_of

LIMIT_BYTES = 64 << 20
#: The query's limit is the lesser of ``LIMIT_BYTES`` and this part of all bytes, so that it splits at every size.
SHARES = 64
#: Bits of one hash; a second hash, of the row number, follows.
BITS = 60
#: Directory cells for each shard that the bytes need at least.
CELLS_A_SHARD = 8
#: A directory of more cells is joined by shuffle.
BROADCAST_CELLS = 1 << 17


def hash_bits(c: Column) -> Column:
    """60 bits of the MD5 of a text, as a long."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def leading(h1: Column, h2: Column, depth: Column) -> Column:
    """The first ``depth`` of the 120 bits of both hashes, as a text of 0 and 1."""
    bits = F.concat(F.lpad(F.bin(h1), BITS, "0"), F.lpad(F.bin(h2), BITS, "0"))
    return F.substring(bits, F.lit(1), depth)


def hash_table(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """Row number, id, both hashes and bytes (``carry``: and the whole row); written
    once so that row numbers stay the same."""
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    d = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col).cast("string")).alias("t"), *row)
    d = d.select("id", *(["row"] if carry else []), F.octet_length("t").cast("long").alias("bytes"),
                 hash_bits(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("|"), F.md5(F.col("t").cast("binary")))).alias("h1"),
                 F.monotonically_increasing_id().alias("uid"))
    return save(d, "hashes").withColumn("h2", hash_bits(F.col("uid").cast("string")))


def cells_under(rows: DataFrame, start: int, deep: int, limit: int) -> DataFrame:
    """Directory cells of the first ``deep`` bits, as a saved table: ``cell``, and of
    the shard that takes it ``depth``, ``shard``, ``shard_bytes``, ``shard_docs`` (null
    where the cell itself is too large)."""
    cells = save(rows.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")), "cells")
    # each cell under all its prefixes: a row for each cell and bit, far fewer than documents
    under = cells.select(F.explode(F.sequence(F.lit(start), F.lit(deep))).alias("depth"), "cell", "bytes", "docs").withColumn(
        "shard", F.substring("cell", F.lit(1), F.col("depth")))
    fits = under.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).where(
        (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    found = under.select("cell", "depth", "shard").join(fits, ["depth", "shard"]).groupBy("cell").agg(
        F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("s"))  # the shortest prefix that fits
    return save(cells.select("cell").join(found, "cell", "left").select("cell", "s.*"), "directory")


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text",
          carry: bool = False, shares: int = 1) -> DataFrame:
    """Per row: ``id``, ``uid``, ``bytes``, ``shard`` (its bits; empty where one shard
    holds all), ``depth``, ``shard_bytes``, ``shard_docs``, ``oversized`` (``carry``: and ``row``,
    a struct of its own columns). No shard but an oversized one is over ``limit`` nor, with
    ``shares`` over 1, over that part of all bytes."""
    rows, start, done = hash_table(docs, id_col, text_col, carry), 0, None
    if shares > 1:
        limit = max(1, min(limit, (rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0) // shares))
    lead = ["id", "uid", "bytes"] + ["row"] * carry
    while True:
        total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
        deep = min(2 * BITS, start + max(4, math.ceil(math.log2(CELLS_A_SHARD * (1 + total / limit)))))
        rows = rows.withColumn("cell", leading(F.col("h1"), F.col("h2"), F.lit(deep)))
        cells = cells_under(rows, start, deep, limit)
        # a directory: cells by the bytes, counted before it is broadcast
        placed = rows.join(broadcast_below(cells, BROADCAST_CELLS), "cell")
        own = placed.where("depth IS NOT NULL") if deep < 2 * BITS else placed  # equal to the last bit: one shard, oversized
        own = own.select(*lead, F.coalesce("shard", "cell").alias("shard"), F.coalesce("depth", F.lit(deep)).cast("long").alias("depth"),
                         "shard_bytes", "shard_docs").withColumn("oversized", F.coalesce(F.col("shard_bytes") > limit, F.lit(True)))
        done = own if done is None else done.unionByName(own)
        if deep == 2 * BITS or not cells.where("depth IS NULL").limit(1).count():
            return done
        rows = save(placed.where("depth IS NULL").select(*lead, "h1", "h2"), "overfull")
        start = deep


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as Parquet: a folder ``shard=s...`` of one file for each shard.
    Returns the shards, with their bytes and documents."""
    placed = shard(docs, limit, id_col, text_col, carry=True)
    name = F.concat(F.lit("s"), "shard").alias("shard")
    placed.select("row.*", name).repartition("shard").write.partitionBy("shard").parquet(path)
    return placed.select(name, "shard_bytes", "shard_docs", "oversized").distinct()


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"), shares=SHARES)
    return placed.select(F.col("id").alias("doc_id"), F.col("bytes").alias("n_bytes"), "shard", "depth", "shard_bytes", "shard_docs", "oversized")


ORACLE = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
most AS (SELECT greatest(1, least({LIMIT_BYTES}, coalesce(sum(n_bytes), 0)::BIGINT // {SHARES})) AS bytes FROM d),
b AS (SELECT *, lpad(ltrim(bin(h), '0'), {BITS}, '0') AS bits FROM d),
u AS (SELECT doc_id, n_bytes, depth, substr(bits, 1, depth::INT) AS shard FROM b, unnest(range(0, {BITS} + 1)) AS x(depth)),
s AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM u GROUP BY depth, shard
      HAVING sum(n_bytes) <= (SELECT bytes FROM most) OR count(*) = 1)
SELECT u.doc_id, u.n_bytes, min_by(s.shard, s.depth) AS shard, min(s.depth) AS depth, min_by(s.shard_bytes, s.depth) AS shard_bytes,
       min_by(s.shard_docs, s.depth) AS shard_docs, min_by(s.shard_bytes, s.depth) > (SELECT bytes FROM most) AS oversized
FROM u JOIN s ON u.depth = s.depth AND u.shard = s.shard GROUP BY u.doc_id, u.n_bytes
"""
