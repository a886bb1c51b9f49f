"""A run configuration as nested JSON (the configuration summary)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def config_json(suite_label: Column | None = None) -> Column:
    """JSON of the configuration columns of a ``run_config`` row; the model
    list keeps name and percentage, credentials are reduced to their count."""
    label = suite_label if suite_label is not None else F.lit("Unknown")
    return F.to_json(F.struct(
        F.struct(F.col("base_url"), F.col("api_path")).alias("endpoint"),
        F.size("tokens").alias("tokens"),
        F.struct(F.col("rate_unit").alias("unit"), F.col("initial_rate").alias("initial"),
                 F.col("max_rate").alias("max"), F.col("scaling_factor"),
                 F.col("time_increment")).alias("rate"),
        F.struct(F.col("min_users").alias("min"), F.col("max_users").alias("max"),
                 F.col("users_increment").alias("increment")).alias("users"),
        F.transform("models", lambda m: F.struct(m["model"].alias("model"),
                                                 m["percentage"].alias("percentage"))).alias("models"),
        F.struct(F.col("benchmark_suite").alias("suite"), label.alias("description")).alias("benchmark"),
        F.col("timeout"),
    ))
