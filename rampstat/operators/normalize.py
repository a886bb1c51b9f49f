"""A2: raw request outcomes -> request rows (classification B1, label B2)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rampstat.functions.outcome import (
    classify_status_sql, error_type_sql, label_or_default_sql, latency_sql, status_code_sql,
)


def normalize_requests(raw: DataFrame) -> DataFrame:
    """Classify each raw outcome. Keeps every other column of ``raw``; adds
    ``status, status_code, latency_ms, error_type, token_label``."""
    keep = [c for c in raw.columns
            if c not in ("raw_code", "raw_exception", "raw_latency", "raw_label")]
    return raw.selectExpr(
        *keep,
        f"{label_or_default_sql()} AS token_label",
        f"{classify_status_sql()} AS status",
        f"{status_code_sql()} AS status_code",
        f"{latency_sql()} AS latency_ms",
        f"{error_type_sql()} AS error_type",
    )
