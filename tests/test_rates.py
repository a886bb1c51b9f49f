"""Rate conversions and text."""

from pyspark.sql import functions as F

from rampstat.functions import (
    allocated_rps, column_suffix, display_to_rps, endpoint_url, format_rate_conversion,
    format_rate_value, planned_interval_s, progress_fraction, report_round, rps_to_display,
    rps_to_display_int, unit_label,
)


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_display_to_rps(spark):
    assert one(spark, display_to_rps(F.lit(10), "rps")) == 10.0
    assert one(spark, display_to_rps(F.lit(60), "rpm")) == 1.0


def test_back_to_integer_display(spark):
    assert one(spark, rps_to_display_int(F.lit(1.0), "rpm")) == 60
    assert one(spark, rps_to_display_int(F.lit(2.5), "rps")) == 2  # half-even


def test_format_rate_value(spark):
    assert one(spark, format_rate_value(F.lit(1.5), "rps")) == "1.50 RPS"
    assert one(spark, format_rate_value(F.lit(1.0), "rpm")) == "60.0 RPM"


def test_format_rate_conversion(spark):
    assert one(spark, format_rate_conversion(F.lit(30), "rpm")) == "30 RPM = 0.50 RPS"
    assert one(spark, format_rate_conversion(F.lit(10), "rps")) == "10 RPS = 10.00 RPS"


def test_to_display_and_suffix(spark):
    assert one(spark, rps_to_display(F.lit(2.0), "rpm")) == 120.0
    assert one(spark, unit_label(F.lit("rpm"))) == "RPM"
    assert column_suffix("rpm") == "rpm" and column_suffix("rps") == "rps"


def test_allocated_rps(spark):
    assert one(spark, allocated_rps(F.lit(10.0), F.lit(50.0))) == 5.0
    assert one(spark, allocated_rps(F.lit(10.0), F.lit(0.0))) == 0.0


def test_guards_and_progress(spark):
    assert one(spark, planned_interval_s(F.lit(0.0))) == 1e6
    assert one(spark, progress_fraction(F.lit(1), F.lit(30.0), F.lit(60.0), F.lit(4))) == 1.5 / 4
    assert one(spark, progress_fraction(F.lit(3), F.lit(90.0), F.lit(60.0), F.lit(4))) == 1.0


def test_report_round_half_even_on_binary_value(spark):
    assert one(spark, report_round(F.lit(0.125), 2)) == 0.12
    assert one(spark, report_round(F.lit(1.005), 2)) == 1.0


def test_endpoint_url(spark):
    df = spark.createDataFrame([("http://h:8000//", "/v1/chat/completions/")], "base_url string, api_path string")
    assert df.select(endpoint_url()).first()[0] == "http://h:8000/v1/chat/completions"
