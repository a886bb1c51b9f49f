import brute
import pytest
from pyspark.sql import functions as F

from rampstat.llm import decontamination as d

ITEMS = [(1, "thing4 matter15 word16 thing5 matter16 word17 thing6 matter17 word18 thing7 matter18 word19"), (2, "Four WORDS"), (3, "Four words"),
         (4, None), (5, "..!"), (None, "one"), (7, "nowhere to be found at all in any of the texts here"), (8, "ab ab ab ab ab ab ab ab ab ab ab ab")]


def run(spark, rows, items):
    items = spark.createDataFrame(items, "item_id long, text string")
    done = d.contamination(brute.frame(spark, rows), items)
    return done.select(F.when(F.col("did") != brute.NONE, F.col("did")), "n_words", "n_hit", F.size("items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256), F.col("n_hit") > 0).collect()


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], []])
def test_odd_cases(spark, items):
    rows = brute.odd_rows()
    brute.same(run(spark, rows, items), brute.decontaminate(rows, items))


def test_empty(spark):
    assert run(spark, [], ITEMS) == []


def test_proximity(spark):
    docs = brute.frame(spark, [(1, "red green blue"), (2, "red dark green blue"), (3, "red very very dark green blue"), (4, "blue green red")])
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    near = lambda slop: {r.did for r in d.find(docs, items, 3, slop)[0].collect()}
    assert near(0) == {1}
    assert near(1) == {1, 2}
    assert near(3) >= {1, 2, 3}


def test_clean_keeps_all_columns(spark):
    docs = brute.frame(spark, [(1, "a b c"), (2, "one two three"), (None, None)])
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns
    brute.same([r[:2] for r in kept.collect()], [(1, "a b c"), (None, None)])
