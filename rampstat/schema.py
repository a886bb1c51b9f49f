"""Schemas of the tables the operators exchange, and fixed catalogue values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the load tester's catalogue for results to match).
# Suite ids in their display order, then (label, detail) per suite.
# ---------------------------------------------------------------------------
SUITES = [
    "coding",
    "math",
    "knowledge",
    "instruction_following",
    "multi_turn",
    "long_context",
    "text_processing",
]
SUITE_DESCRIPTIONS = {
    "coding": ("Coding", "Algorithm, debugging, code generation"),
    "math": ("Math", "Word problems, probability, calculus"),
    "knowledge": ("Knowledge", "Science, history, domain expertise"),
    "instruction_following": ("Instruction", "Strict formatting and constraints"),
    "multi_turn": ("Multi-Turn", "Conversational context"),
    "long_context": ("Long Context", "8K-20K+ word documents"),
    "text_processing": ("Text Processing", "Summarization, extraction, classification"),
}
# Guards used by the rate arithmetic.
MIN_ELAPSED_S = 0.001
MIN_RATE_RPS = 1e-6
# Setting ranges enforced by the configuration form (rule C9).
RATE_RANGE = (1, 2000)
FACTOR_RANGE = (1.1, 10.0)
STAGE_SECONDS_RANGE = (5, 300)
TIMEOUT_RANGE = (1, 600)
ROWS_RANGE = (10, 10000)
MAX_MODELS = 10
MAX_USERS_CAP = 100

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
REQUEST = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("stage_index", T.IntegerType()),
    T.StructField("model", T.StringType()),
    T.StructField("model_percentage", T.DoubleType()),
    T.StructField("token_index", T.LongType()),
    T.StructField("token_label", T.StringType()),
    T.StructField("active_users", T.IntegerType()),
    T.StructField("target_rps", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("suite_id", T.StringType()),
    T.StructField("prompt_id", T.StringType()),
])
