"""rampstat - request-log analytics for load-test runs on Spark.

DataFrame -> DataFrame operators that normalise raw request outcomes, expand
ramp schedules into stages, assign requests to stages / models / credentials /
prompts, and report per-stage, per-model and per-run counts, rates, error rates
and exact floor-rank latency percentiles - batch and Structured Streaming.
"""

__version__ = "0.1.0"
