"""A3: credential CSV files -> good credentials and reject messages.

Rules (one text per file):
* the text is stripped first; an empty text yields nothing;
* the first line is a header only if its cells, trimmed and lower-cased,
  contain both ``token`` and ``label`` (any order, any other columns);
* with a header the label comes from its column (trimmed, may be blank); a
  row too short for it gets ``user-{i}``; without a header the second column
  is ignored and the label is ``token-{i}``;
* a blank token rejects the row: ``Row {i}: missing token value``;
* ``i`` is the 1-based record number, the header included; a line end inside
  quotes does not end a record.

Spark's CSV reader skips blank lines, while the rules count them (a blank
line is a rejected row), so files are read as whole texts and their records
numbered. Only a SHA-256 of each token is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records in one text file of a credential file that is stored in runs.
RUN_LINES = 20_000

# One cell: quoted (doubled quotes and line ends inside belong to it, text after the
# closing quote too) or plain. Possessive, so matching takes linear time.
_CELL = r'(?:"(?:[^"]++|"")*+(?:"[^,\r\n]*+)?+|[^,\r\n]*+)'
_RECORD = rf"({_CELL}(?:,{_CELL})*+)(?:\r?\n|\r|\z)"


def _strip(col: Column) -> Column:
    """Python-style strip of surrounding whitespace."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def csv_records(text: Column) -> Column:
    """The records of a CSV text without trailing line ends: a line end inside quotes
    does not end a record, blank lines are records."""
    found = F.regexp_extract_all(text, F.lit(_RECORD), F.lit(1))
    return F.slice(found, 1, F.size(found) - 1)  # the last match is the empty end


def csv_cells(record: Column) -> Column:
    """The cells of one CSV record; quoted cells lose their quotes and doubled
    quotes collapse."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_CELL})"), F.lit(1))
    quoted = r'(?s)\A"((?:[^"]++|"")*+)"?+(.*)\z'
    return F.transform(raw, lambda c: F.when(c.startswith('"'), F.concat(
        F.regexp_replace(F.regexp_extract(c, quoted, 1), '""', '"'), F.regexp_extract(c, quoted, 2))).otherwise(c))


def read_credential_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per record: (file, line_no 1-based, line). Each file is one whole text
    (what was pasted or uploaded for one run, so a task's memory holds it), stripped,
    then cut into records."""
    texts = spark.read.text(paths, wholetext=True).select(
        F.input_file_name().alias("file"), _strip(F.col("value")).alias("text"))
    texts = texts.where(F.length("text") > 0)
    return texts.select("file", F.posexplode(csv_records(F.col("text"))).alias("pos", "line")).select(
        "file", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


def write_credential_runs(lines: DataFrame, root: str, run_lines: int = RUN_LINES) -> None:
    """Store numbered lines (file, line_no from 1 without gaps, line: a whole record) as
    text files of at most ``run_lines`` records: files grow in number, not in length."""
    run = F.expr(f"(line_no - 1) div {run_lines}").alias("run")
    texts = lines.select("file", run, "line_no", "line").groupBy("file", "run").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select(
        "file", "run", F.array_join("l.line", "\n", "").alias("value"))
    texts.write.partitionBy("file", "run").text(root)


def read_credential_runs(spark: SparkSession, root: str, run_lines: int = RUN_LINES) -> DataFrame:
    """What ``write_credential_runs`` stored, as ``read_credential_files`` gives it of whole
    files: (file, line_no, line), each file stripped as if it were one text."""
    path, n = F.input_file_name(), F.col("line_no")
    texts = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(
        F.regexp_extract(path, r"/file=(-?\d+)/", 1).cast("int").alias("file"),
        F.regexp_extract(path, r"/run=(\d+)/", 1).cast("long").alias("run"), "value")
    rows = texts.select("file", "run", F.posexplode(csv_records(F.col("value"))).alias("pos", "line")).select(
        "file", (F.col("run") * run_lines + F.col("pos") + 1).alias("line_no"), "line")
    # blank lines before the first other one, and after the last, don't count
    ends = rows.where(_strip(F.col("line")) != "").groupBy("file").agg(F.min(n).alias("_first"), F.max(n).alias("_last"))
    line = F.when(n == F.col("_first"), F.regexp_replace("line", r"^\s+", "")).otherwise(F.col("line"))
    return rows.join(ends, "file").where(n.between(F.col("_first"), F.col("_last"))).select(
        "file", (n - F.col("_first") + 1).alias("line_no"),
        F.when(n == F.col("_last"), F.regexp_replace(line, r"\s+$", "")).otherwise(line).alias("line"))


def parse_credential_lines(lines: DataFrame, file_col: str = "file") -> tuple[DataFrame, DataFrame]:
    """(good, rejects) from numbered lines (file, line_no, line).

    good: (file, line_no, token_sha256, label); rejects: (file, line_no, message)."""
    first = lines.where(F.col("line_no") == 1).select(
        F.col(file_col).alias("_f"),
        F.transform(csv_cells(F.col("line")), lambda c: F.lower(_strip(c))).alias("_h"))
    hdr = first.select(
        "_f",
        (F.array_contains("_h", "token") & F.array_contains("_h", "label")).alias("_has_header"),
        (F.array_position("_h", "token") - 1).cast("int").alias("_tcol"),
        (F.array_position("_h", "label") - 1).cast("int").alias("_lcol"))
    j = lines.join(hdr, lines[file_col] == hdr["_f"], "left")
    has = F.coalesce(F.col("_has_header"), F.lit(False))
    j = j.where(~(has & (F.col("line_no") == 1)))
    cells = csv_cells(F.col("line"))
    tcol = F.when(has, F.col("_tcol")).otherwise(F.lit(0))
    token = F.when(tcol < F.size(cells), _strip(F.element_at(cells, tcol + 1))).otherwise(F.lit(""))
    i = F.col("line_no").cast("string")
    label = (F.when(has & (F.col("_lcol") < F.size(cells)),
                    _strip(F.element_at(cells, F.col("_lcol") + 1)))
             .when(has, F.concat(F.lit("user-"), i))
             .otherwise(F.concat(F.lit("token-"), i)))
    parsed = j.select(lines[file_col].alias(file_col), "line_no", token.alias("_token"),
                      label.alias("label"))
    good = parsed.where(F.col("_token") != "").select(
        file_col, "line_no", F.sha2(F.col("_token"), 256).alias("token_sha256"), "label")
    rejects = parsed.where(F.col("_token") == "").select(
        file_col, "line_no",
        F.concat(F.lit("Row "), F.col("line_no").cast("string"), F.lit(": missing token value"))
        .alias("message"))
    return good, rejects


def credential_lines_from_customers(customer: DataFrame) -> DataFrame:
    """Credential 'files' derived from the customer table: one file per
    nation, one line per customer (ordered by key); a third of the files
    start with ``token,label``, a third with `` Label , TOKEN `` (swapped
    columns, odd spacing and case), a third have no header. Tokens are blank
    for keys divisible by 13; every seventh row is short (no label); labels
    are blank for keys divisible by 17."""
    from rampstat.operators.ranking import row_number_in_group
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    kind = (n % 3).cast("int")
    token = F.when(c % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("sk-"), c.cast("string")))
    label = F.when(c % 17 == 0, F.lit("")).otherwise(F.col("c_name"))
    line = (F.when(c % 7 == 0, token)
            .when(kind == 1, F.concat(label, F.lit(","), token))
            .otherwise(F.concat(token, F.lit(","), label)))
    rows = customer.select(n.alias("file"), c, kind.alias("kind"), line.alias("line"))
    numbered = row_number_in_group(rows, ["file"], ["c_custkey"], name="_pos")
    body = numbered.select("file", (F.col("_pos") + F.when(F.col("kind") < 2, 1).otherwise(0))
                           .cast("long").alias("line_no"), "line")
    headers = customer.select(n.alias("file")).distinct().where(F.col("file") % 3 < 2).select(
        "file", F.lit(1).cast("long").alias("line_no"),
        F.when(F.col("file") % 3 == 0, F.lit("token,label")).otherwise(F.lit(" Label , TOKEN "))
        .alias("line"))
    return body.unionByName(headers)
