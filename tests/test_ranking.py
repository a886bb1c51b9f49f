"""Range-partitioned running sums equal a single-task window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rampstat.operators.ranking import row_number_in_group, running_sums


def test_running_sums_equal_window(spark):
    df = spark.range(0, 20000).select((F.col("id") % 3).alias("g"),
                                      (F.xxhash64("id") % 500).alias("x"), "id")
    out = running_sums(df, ["g"], ["x", "id"], {"cum": F.lit(1), "sx": F.col("x")}, num_partitions=7)
    w = Window.partitionBy("g").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("*", F.count("*").over(w).alias("cum"), F.sum("x").over(w).alias("sx"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, ref.collect()))


def test_one_dominant_group_spans_partitions(spark):
    # 90 % of the rows in one group: the group is split over many partitions
    df = spark.range(0, 10000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99)
                                      .alias("g"), "id")
    out = row_number_in_group(df, ["g"], ["id"], name="rn", num_partitions=8)
    w = Window.partitionBy("g").orderBy("id")
    ref = df.select("*", F.row_number().over(w).cast("long").alias("rn"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, ref.collect()))


def test_small_arrow_batches_carry_across(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 500).select((F.col("id") % 2).alias("g"), "id")
        out = row_number_in_group(df, ["g"], ["id"], name="rn", num_partitions=3)
        got = sorted((r.g, r.id, r.rn) for r in out.collect())
        assert got == sorted((i % 2, i, i // 2 + 1) for i in range(500))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_group_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3)], "g int, x int")
    out = {(r.g, r.x): r.c for r in running_sums(df, ["g"], ["x"], {"c": F.lit(1)}).collect()}
    assert out == {(None, 1): 1, (None, 2): 2, (1, 3): 1}


def test_aqe_coalesced_ranges_stay_in_order(spark):
    # many shuffle partitions on small data: AQE coalesces adjacent ranges
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = spark.range(0, 30000).select((F.col("id") % 5).alias("g"),
                                          (F.xxhash64("id") % 700).alias("x"), "id")
        w = Window.partitionBy("g").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, 0)
        ref = sorted(map(tuple, df.select("*", F.count("*").over(w).alias("c")).collect()))
        out = running_sums(df, ["g"], ["x", "id"], {"c": F.lit(1)})
        assert sorted(map(tuple, out.collect())) == ref
        rn = row_number_in_group(df, ["g"], ["x", "id"], name="c")
        assert sorted(map(tuple, rn.collect())) == ref
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_null_keys_and_nullable_longs_across_small_batches(spark):
    """Groups with null and NaN keys run on over Arrow batches, and BIGINTs beside nulls
    keep every digit."""
    big = 9007199254740993
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 300).select(
            F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"),
            F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(1.5).alias("f"), "id",
            F.when(F.col("id") % 5 > 0, F.col("id") + big).alias("payload"),
            F.when(F.col("id") % 4 > 0, F.col("id") + big).alias("v"))
        w = Window.partitionBy("g", "f").orderBy("id")
        rows = w.rowsBetween(Window.unboundedPreceding, 0)
        want = df.select("*", F.count("*").over(rows).alias("c"), F.coalesce(F.sum("v").over(rows), F.lit(0)).alias("s"),
                         F.count("*").over(Window.partitionBy("g", "f")).alias("c_total"))
        for parts in (1, 4):
            got = running_sums(df, ["g", "f"], ["id"], {"c": F.lit(1), "s": "v"}, parts, with_totals=True)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fractional_weights_are_refused(spark):
    import pytest
    with pytest.raises(TypeError):
        running_sums(spark.range(3).withColumn("x", F.lit(0.5)), [], ["id"], {"s": "x"})


def test_written_tables_are_released(spark):
    from rampstat.session import release
    row_number_in_group(spark.range(10).withColumn("g", F.lit(1)), ["g"], ["id"]).collect()
    assert release(spark) >= 1 and release(spark) == 0


def test_previous_in_group_equals_lag(spark):
    from rampstat.operators.ranking import previous_in_group
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(0, 400).select(F.when(F.col("id") % 9 > 0, F.col("id") % 3).alias("g"), "id",
                                        F.when(F.col("id") % 4 > 0, F.concat(F.lit("v"), "id")).alias("v"), F.expr("timestamp_seconds(id)").alias("ts"))
        for value in ("v", "ts", "id"):
            want = df.withColumn("p", F.lag(value).over(Window.partitionBy("g").orderBy("id")))
            for parts in (1, 5, 40):
                got = previous_in_group(df, ["g"], ["id"], value, "p", parts)
                assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
