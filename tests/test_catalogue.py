"""Prompt catalogue and suites."""

from pyspark.sql import functions as F

from rampstat.functions.text import parse_prompt_id
from rampstat.schema import SUITES
from rampstat.sources import catalogue as cat


def test_suites_in_order_with_distinct_labels(spark):
    s = cat.suites(spark).orderBy("suite_order").collect()
    assert [r.suite_id for r in s] == SUITES
    c = cat.suite_counts(cat.suites(spark), cat.from_map(spark, {"coding": ["a", "b"]})).collect()
    assert all(r.labels_distinct and r.details_distinct for r in c)
    by = {r.suite_id: r.n_prompts for r in c}
    assert by["coding"] == 2 and by["math"] == 0


def test_map_flattening_and_ids(spark):
    p = cat.from_map(spark, {"math": ["x", "y"], "coding": ["z"]})
    ids = sorted(r.prompt_id for r in cat.prompt_catalogue(p, cat.suites(spark)).collect())
    assert ids == ["coding-1", "math-1", "math-2"]


def test_prompt_id_parse(spark):
    df = spark.createDataFrame([("math-3",), ("coding",), ("math-x",)], "prompt_id string")
    got = [(r.p["suite"], r.p["index"]) for r in df.select(parse_prompt_id().alias("p")).collect()]
    assert got == [("math", 2), ("coding", 0), ("math", None)]


def test_coverage_and_lookup(spark):
    p = cat.from_map(spark, {s: ["t"] for s in SUITES[:-1]})
    cov = [(r.suite_id, r.issue) for r in cat.suite_coverage(cat.suites(spark), cat.descriptions(spark), p).collect()]
    assert cov == [("text_processing", "no_prompts")]
    df = spark.createDataFrame([("coding",), ("nope",)], "benchmark_suite string")
    got = sorted((r.benchmark_suite, r.suite_label, r.suite_detail)
                 for r in cat.suite_lookup(df, cat.descriptions(spark)).collect())
    assert got[1] == ("nope", "Unknown", "") and got[0][1] == "Coding"


def test_get_suite_absent_is_empty(spark):
    p = cat.from_map(spark, {"math": ["x"]})
    assert cat.get_suite(p, "nope").count() == 0 and cat.get_suite(p, "math").count() == 1
    assert F
