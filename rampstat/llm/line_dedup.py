"""Line dedup: lines that several documents hold stay only in the first of them.

Lines are exploded and hashed; a hash that ``min_docs`` distinct documents
hold is a boilerplate line. Its lines go from all documents but the one with
the smallest id, and the rest is put together again by position.

Only hashes and positions are shuffled by line; texts move once, to meet the
keep flags of their own lines. Counting is map-side combined, first by hash
and document, then by hash, so a line that a third of all documents hold costs
one row per task. The flags of such a line are joined by hash, where adaptive
execution splits the skewed side.

Defined cases: a null or empty text is one empty line; short lines (fewer than
``min_chars`` code points after stripping) always stay; rows that repeat both id
and text are one document and come out as often as they came in; rows that share
an id but not a text count as one holder; a null id ranks as the largest id and
comes out null; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.common import SPACE, ascii_lower, digest, given_id, hash128, known_id, table, text_of

MIN_CHARS = 10
MIN_DOCS = 2


def line_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per distinct (id, text) that loses lines: ``did``, ``tid`` (digest
    of the text), ``gone`` (positions to drop, as an array of booleans by line)."""
    lines = docs.select(known_id(F.col(id_col)).alias("did"), text_of(F.col(text_col)).alias("t")).select(
        "did", digest(F.col("t")).alias("tid"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACE))
    lines = lines.where(F.char_length(key) >= min_chars).select("did", "tid", "pos", *hash128(ascii_lower(key)))
    holders = lines.groupBy("h1", "h2", "did").agg(F.lit(1).alias("one"))
    common = holders.groupBy("h1", "h2").agg(F.sum("one").alias("n"), F.min("did").alias("keeper")).where(F.col("n") >= min_docs)
    hit = lines.join(common.drop("n"), ["h1", "h2"]).where("did <> keeper")
    # a document's dropped positions: bounded by its own lines
    return hit.groupBy("did", "tid").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Per input row: ``did`` (null id as NO_ID), ``n_lines``, ``n_dropped`` and
    ``kept`` (the text without its dropped lines), beside ``row``, a struct of
    all the row's own columns."""
    flags = line_flags(docs, id_col, text_col, min_chars, min_docs).select(
        F.col("did").alias("fid"), F.col("tid").alias("ftid"), "gone")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), known_id(F.col(id_col)).alias("did"),
                    text_of(F.col(text_col)).alias("t"))
    d = d.withColumn("tid", digest(F.col("t")))
    d = d.join(flags, (d.did == flags.fid) & (d.tid == flags.ftid), "left")
    lines = F.split("t", "\n", -1)
    # dropped positions are sorted: the lines between two of them stay
    bounds = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(lines)))
    spans = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda i: F.slice(
        F.col("lines"), F.get("bounds", i) + 2, F.get("bounds", i + 1) - F.get("bounds", i) - 1))
    kept = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.flatten(spans), "\n"))
    return (d.withColumn("lines", lines).withColumn("bounds", bounds)
            .select("row", "did", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents"))
    return done.select(given_id(F.col("did")).alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
      FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
