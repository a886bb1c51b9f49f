import brute
from pyspark.sql import functions as F

from rampstat.llm import line_dedup


def run(docs, **more):
    done = line_dedup.dedup_lines(docs, **more)
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256)).collect()


def test_odd_cases(spark):
    rows = brute.odd_rows()
    brute.same(run(brute.frame(spark, rows)), brute.line_dedup(rows))


def test_threshold_counts_documents_not_lines(spark):
    rows = [(1, "the very same line\nthe very same line"), (2, "the very same line"), (3, "the very same line")]
    assert {r[0]: r[2] for r in run(brute.frame(spark, rows))} == {1: 0, 2: 1, 3: 1}
    assert {r[0]: r[2] for r in run(brute.frame(spark, rows), min_docs=4)} == {1: 0, 2: 0, 3: 0}


def test_empty(spark):
    assert run(brute.frame(spark, [])) == []


def test_no_python_in_the_plan(spark):
    plan = line_dedup.dedup_lines(brute.frame(spark, brute.odd_rows()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
