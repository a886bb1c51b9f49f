"""A training corpus from raw documents: quality rules, line dedup, near-dedup,
benchmark decontamination, packing.

Each stage works on what the one before has kept, is written as Parquet, and is
read again as the next one's documents. All but the last return the columns of
``documents`` (``n_chars`` follows a text that lost lines). Each stage handles the
empty table, nulls, repeated rows and extra columns as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm import decontamination, line_dedup, near_dedup, packing, quality
from rampstat.llm.common import known_id, save, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the classifier reject go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go, and documents that have lost lines and
    have no word left."""
    done = line_dedup.dedup_lines(docs).where((F.col("n_dropped") == 0) | F.rlike("kept", F.lit(r"[^\x20\x09-\x0D]")))
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text")).alias("text"),
               "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars")}
    return done.select(*[changed.get(c, F.col(f"row.`{c}`")) for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    A near copy shares most lines with its original, so line dedup leaves it only what differs.
    Documents are compared as the corpus has them, before their lines went, and those that
    stay once more by the texts that they come with."""
    did = lambda d: d.select(known_id(F.col("doc_id")).alias("did"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    whole = table(spark, sf_dir, "documents").select("doc_id", "text", known_id(F.col("doc_id")).alias("did"))
    whole = whole.join(did(docs).distinct(), "did", "left_semi").select("doc_id", "text")
    found = save(near_dedup.near_duplicates(whole).groupBy("did").agg(F.max("kept").alias("kept")), "near-as-given")
    gone = found.where("NOT kept").select("did")
    left = docs.select(row, known_id(F.col("doc_id")).alias("did")).join(gone, "did", "left_anti").select("row.*")
    return near_dedup.keep_first(save(left, "near-left"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their sequences and places there."""
    return packing.packed_columns(packing.pack_documents(docs, packing.tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("packing", best_fit_packing),
]

#: The classifier, the tokenizer and near-dedup's components have no SQL form; the
#: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
