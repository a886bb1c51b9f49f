"""Outcome classification of one request.

A raw outcome is (HTTP code or null, exception class name or null, measured
latency). The conventions:

* an exception named ``timeout`` is a timeout: status ``timeout``, no code,
  latency 0.0, error type ``timeout``;
* any other exception is ``error``, no code, latency 0.0, error type = the
  exception class name;
* otherwise the HTTP code decides: 200..399 (3xx included) is ``success``,
  anything else ``failure``; HTTP failures carry no error type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null_to_empty(col="error_type") -> Column:
    return F.coalesce(_c(col), F.lit(""))


# The rules as SQL text: plans are built from expression strings.
def classify_status_sql(code: str = "raw_code", exception: str = "raw_exception") -> str:
    return (f"CASE WHEN {exception} = 'timeout' THEN 'timeout' WHEN {exception} IS NOT NULL THEN 'error' "
            f"WHEN {code} BETWEEN 200 AND 399 THEN 'success' ELSE 'failure' END")


def status_code_sql(code: str = "raw_code", exception: str = "raw_exception") -> str:
    return f"CASE WHEN {exception} IS NULL THEN CAST({code} AS INT) END"


def latency_sql(latency: str = "raw_latency", exception: str = "raw_exception") -> str:
    return f"CASE WHEN {exception} IS NULL THEN CAST({latency} AS DOUBLE) ELSE 0.0D END"


def error_type_sql(exception: str = "raw_exception") -> str:
    return f"CASE WHEN {exception} IS NOT NULL THEN {exception} END"


def label_or_default_sql(label: str = "raw_label", index: str = "token_index", prefix: str = "user-") -> str:
    return f"coalesce(nullif({label}, ''), concat('{prefix}', CAST({index} AS STRING)))"
