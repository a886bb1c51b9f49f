"""Exact dedup: sorted digest runs, merged by a tree of exchanges between partitions.

Every row becomes a small entry: the SHA-256 of its normalised text, the text's length
and a second, independent hash of it, the id, and how many rows it stands for. The
entries of a partition, sorted and with equal ones folded, are its run. Runs then meet
in binomial rounds: in each round ``FAN_IN`` runs, whose numbers differ in one digit
alone, exchange entries so that each gets those whose digest has its own number as
that digit, and merges what the others sent with its own. A round does the work of
three rounds between pairs. After the last one every digest is in one run, and the
runs share all digests evenly: no run ever gets them all.

At every level the entries of a text are folded to the smallest id. Two entries count
as one text only if digest, length and second hash agree, and a merge raises an
error if its input is out of order, so what it retains is the smallest.

Then the merged entries go back to the runs of the first level, an entry for each text
of a run, and from these to the rows, by run and digest. A text that a third of
all rows hold is thus an entry in each run, never a group of rows in one task.

Defined cases: a null text counts as empty, and white space is not stripped at the
ends, only reduced to one space; a null id ranks as the largest id and comes out null;
of rows that share the smallest id the first in the table's order stays; an empty
table gives an empty result. Texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rampstat.llm.common import given_id, known_id, save, ship, table, text_of

#: Runs that exchange entries in one round: a power of two.
FAN_IN = 8

TEXT = ["digest", "n_bytes", "second"]
ENTRY = "run long, digest binary, n_bytes long, second long, did long, uid long, size long"
ORDER = ["run", *TEXT, "did", "uid"]


def entries_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """An entry for each row; ``run`` is the number of its partition, ``uid`` its own."""
    d = docs.select(known_id(F.col(id_col)).alias("did"),
                    F.regexp_replace(text_of(F.col(text_col)), r"[ \t-\r]+", " ").cast("binary").alias("b"))
    return d.select(F.spark_partition_id().cast("long").alias("run"), F.unhex(F.sha2("b", 256)).alias("digest"),
                    F.octet_length("b").cast("long").alias("n_bytes"), F.xxhash64("b").alias("second"), "did",
                    F.monotonically_increasing_id().alias("uid"), F.lit(1).cast("long").alias("size"))


def merge_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sorted entries with those of one text in one run folded into the first of them."""
    column = lambda name: batch.column(name).to_numpy()
    digest = batch.column("digest").cast(pa.binary(32))
    words = np.frombuffer(digest.buffers()[1], np.uint64)[4 * digest.offset:4 * (digest.offset + len(digest))].reshape(-1, 4)
    key = np.column_stack([column("run"), column("n_bytes"), column("second"), words.view(np.int64)])
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    did, uid = column("did"), column("uid")
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(did))))
    least_did, least_uid = did[first][group], uid[first][group]
    if ((did < least_did) | ((did == least_did) & (uid < least_uid))).any():
        raise ValueError("a run is out of order: its first entries are not the smallest")
    out = batch.take(pa.array(first))
    return out.set_column(out.schema.get_field_index("size"), "size", pa.array(np.add.reduceat(column("size"), first)))


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Multiway merge of what Spark hands over sorted by ``ORDER``: an entry for each
    text of a run. Holds one batch and the text that it ends in."""
    last = None
    for batch in batches:
        if batch.num_rows:
            merged = merge_batch(batch if last is None else pa.concat_batches([last, batch]))
            yield merged.slice(0, merged.num_rows - 1)
            last = merged.slice(merged.num_rows - 1)
    if last is not None:
        yield last


def first_runs(entries: DataFrame) -> DataFrame:
    """The sorted run of each partition as it lies: no exchange."""
    return entries.sortWithinPartitions(*ORDER).mapInArrow(merge_runs, ENTRY)


def digit_of_digest(turn: int):
    """The digest's ``turn``-th digit to the base ``FAN_IN``."""
    lead = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    return F.shiftright(lead, turn * (FAN_IN.bit_length() - 1)).bitwiseAND(F.lit(FAN_IN - 1))


def exchange(runs: DataFrame, turn: int) -> DataFrame:
    """One round: the runs whose numbers differ in the ``turn``-th digit alone deal
    their entries out among themselves and merge what they get."""
    step = FAN_IN ** turn
    own = F.pmod(F.floor(F.col("run") / step), F.lit(FAN_IN))
    moved = runs.withColumn("run", F.col("run") + (digit_of_digest(turn) - own) * step)
    return moved.repartition("run").sortWithinPartitions(*ORDER).mapInArrow(merge_runs, ENTRY)


def rounds_for(runs: int) -> int:
    """Rounds after which ``runs`` runs have all met."""
    turns = 1
    while FAN_IN ** turns < runs:
        turns += 1
    return turns


def merge_tree(runs: DataFrame) -> DataFrame:
    """An entry for each text of the whole table: smallest id, and all its rows counted."""
    last = runs.agg(F.max("run")).first()[0]
    for turn in range(rounds_for(0 if last is None else last + 1)):
        runs = exchange(runs, turn)
    return runs


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``did``, ``keep_id`` (as ``did``), ``group_size``, ``kept``, and the text's
    ``digest``, ``n_bytes`` and ``second``."""
    ship(docs.sparkSession)
    rows = save(entries_of(docs, id_col, text_col), "digests")
    # the run of a file of the stored table need not be the partition that wrote it
    runs = save(first_runs(rows.repartition("run")), "digest-runs")
    merged = save(merge_tree(runs), "digests-merged").select(
        *TEXT, F.col("did").alias("keep_id"), F.col("uid").alias("keep_uid"), F.col("size").alias("group_size"))
    told = runs.select("run", *TEXT).join(merged, TEXT)
    out = rows.select("run", *TEXT, "did", "uid").join(told, ["run", *TEXT])
    return out.select("did", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), *TEXT)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one of each text, with all their columns as they are."""
    kept = exact_copies(docs, id_col, text_col).where("kept").select("did", *TEXT)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, known_id(F.col(id_col)).alias("did"),
                    F.regexp_replace(text_of(F.col(text_col)), r"[ \t-\r]+", " ").cast("binary").alias("b"))
    d = d.select("row", "did", F.unhex(F.sha2("b", 256)).alias("digest"), F.octet_length("b").cast("long").alias("n_bytes"), F.xxhash64("b").alias("second"))
    found = d.join(kept, ["did", *TEXT], "left_semi")
    return found.groupBy("did", *TEXT).agg(F.first("row").alias("row")).select("row.*")  # rows that repeat id and text


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_copies(table(spark, sf_dir, "documents"))
    return done.select(given_id(F.col("did")).alias("doc_id"), given_id(F.col("keep_id")).alias("keep_id"), "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
