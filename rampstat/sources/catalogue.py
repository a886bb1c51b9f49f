"""Prompt catalogue and suite dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rampstat.functions.text import parse_prompt_id, prompt_id
from rampstat.schema import SUITE_DESCRIPTIONS, SUITES


def suites(spark: SparkSession) -> DataFrame:
    """A5: the suite dimension in display order (7 fixed rows)."""
    rows = [(i, s, SUITE_DESCRIPTIONS.get(s, (None, None))[0], SUITE_DESCRIPTIONS.get(s, (None, None))[1])
            for i, s in enumerate(SUITES)]
    return spark.createDataFrame(rows, "suite_order int, suite_id string, label string, detail string")


def descriptions(spark: SparkSession) -> DataFrame:
    """Description keys as a table (suite_id, label, detail)."""
    rows = [(k, v[0], v[1]) for k, v in SUITE_DESCRIPTIONS.items()]
    return spark.createDataFrame(rows, "suite_id string, label string, detail string")


def from_map(spark: SparkSession, prompts_by_suite: dict[str, list[str]]) -> DataFrame:
    """A4/H4: a suite -> prompts map flattened to (suite_id, prompt_index, text)
    with ``explode`` + ``posexplode``."""
    m = spark.createDataFrame([(prompts_by_suite,)], "m map<string,array<string>>")
    return flattened(m.select(F.explode("m").alias("suite_id", "texts")))


def flattened(lists: DataFrame) -> DataFrame:
    """H4: (suite_id, texts), a list per suite, to (suite_id, prompt_index, text)."""
    return (lists.select("suite_id", F.posexplode("texts").alias("prompt_index", "text"))
            .select("suite_id", F.col("prompt_index").cast("long").alias("prompt_index"), "text"))


def prompt_catalogue(prompts: DataFrame, suites_df: DataFrame) -> DataFrame:
    """Prompt ids built ('suite-N', 1-based) and parsed back (B11/B12), in
    suite order (G3)."""
    parsed = parse_prompt_id(F.col("prompt_id"))
    j = prompts.join(suites_df.select("suite_id", "suite_order"), "suite_id", "left")
    return j.withColumn("prompt_id", prompt_id("suite_id", "prompt_index")).select(
        "suite_order", "suite_id", "prompt_index", "prompt_id",
        parsed["suite"].alias("parsed_suite"), parsed["index"].cast("long").alias("parsed_index"),
        F.length("text").cast("long").alias("n_chars"))


def get_suite(prompts: DataFrame, name: str) -> DataFrame:
    """The prompts of one suite; empty when the suite is absent."""
    return prompts.where(F.col("suite_id") == F.lit(name))


def prompt_at(prompts: DataFrame, requests: DataFrame, suite_col: str = "suite_id",
              index_col: str = "prompt_index") -> DataFrame:
    """D6 lookup with wraparound: prompt ``index % n`` of the suite; '' when
    the suite has none."""
    from rampstat.operators.assign import assign_prompt
    return assign_prompt(requests.withColumnRenamed(index_col, "seq"), prompts, suite_col)


def suite_lookup(df: DataFrame, descs: DataFrame, suite_col: str = "benchmark_suite") -> DataFrame:
    """Suite -> (label, detail); unknown suites give ('Unknown', '')."""
    d = descs.select(F.col("suite_id").alias("_sid"), F.col("label").alias("suite_label"),
                     F.col("detail").alias("suite_detail"))
    j = df.join(d, df[suite_col] == d["_sid"], "left")
    return j.select(*df.columns,
                    F.coalesce(F.col("suite_label"), F.lit("Unknown")).alias("suite_label"),
                    F.coalesce(F.col("suite_detail"), F.lit("")).alias("suite_detail"))


def suite_coverage(suites_df: DataFrame, descs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Suites without prompts, suites without a description, and
    description keys that are not suites (anti joins both ways)."""
    p = prompts.select("suite_id").distinct()
    no_prompts = suites_df.select("suite_id").join(p, "suite_id", "left_anti") \
        .withColumn("issue", F.lit("no_prompts"))
    no_desc = suites_df.select("suite_id").join(descs.select("suite_id"), "suite_id", "left_anti") \
        .withColumn("issue", F.lit("no_description"))
    stray = descs.select("suite_id").join(suites_df.select("suite_id"), "suite_id", "left_anti") \
        .withColumn("issue", F.lit("not_a_suite"))
    return no_prompts.unionByName(no_desc).unionByName(stray)


def suite_counts(suites_df: DataFrame, prompts: DataFrame) -> DataFrame:
    """E11 prompts per suite (and whether it has any) + E10 distinctness of
    labels and details over the dimension."""
    cnt = prompts.groupBy("suite_id").agg(F.count("*").cast("long").alias("n_prompts"))
    # the dimension has a fixed handful of rows: a window over all of it is bounded
    whole = Window.partitionBy()
    j = suites_df.join(cnt, "suite_id", "left").select(
        "*",
        (F.size(F.collect_set("label").over(whole)) == F.count("label").over(whole)).alias("labels_distinct"),
        (F.size(F.collect_set("detail").over(whole)) == F.count("detail").over(whole)).alias("details_distinct"))
    return j.select("suite_order", "suite_id", "label", "detail",
                    F.coalesce(F.col("n_prompts"), F.lit(0)).cast("long").alias("n_prompts"),
                    (F.coalesce(F.col("n_prompts"), F.lit(0)) > 0).alias("has_prompts"),
                    "labels_distinct", "details_distinct")
