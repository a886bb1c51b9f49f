"""String builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def endpoint_url(base="base_url", path="api_path") -> Column:
    """Base without trailing slashes + '/' + path without edge slashes."""
    return F.concat(F.expr(f"trim(TRAILING '/' FROM {base})") if isinstance(base, str)
                    else F.rtrim(_c(base), F.lit("/")),
                    F.lit("/"),
                    F.expr(f"trim(BOTH '/' FROM {path})") if isinstance(path, str)
                    else F.btrim(_c(path), F.lit("/")))


def endpoint_url_view(base="base_url", path="api_path") -> Column:
    """B10, view variant: only leading slashes of the path are dropped."""
    return F.concat(F.expr(f"trim(TRAILING '/' FROM {base})"), F.lit("/"),
                    F.expr(f"trim(LEADING '/' FROM {path})"))


def prompt_id(suite="suite_id", index="prompt_index") -> Column:
    """B11: 'suite-N' with N 1-based."""
    return F.concat_ws("-", _c(suite), (_c(index) + F.lit(1)).cast("string"))


def parse_prompt_id(pid="prompt_id") -> Column:
    """B12: 'suite-N' -> struct(suite, index 0-based). No dash -> index 0;
    a non-number after the dash gives a null index (the caller rejects it)."""
    parts = F.split(_c(pid), "-", 2)
    number = F.get(parts, F.lit(1)).try_cast("int")
    idx = F.when(F.size(parts) > 1, F.try_subtract(number, F.lit(1))).otherwise(F.lit(0))
    return F.struct(parts.getItem(0).alias("suite"), idx.alias("index"))


def request_payload(model="model", text="text") -> Column:
    """Chat-completion request body: one user message, no streaming,
    temperature 0."""
    return F.to_json(F.struct(
        _c(model).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), _c(text).alias("content"))).alias("messages"),
        F.lit(False).alias("stream"),
        F.lit(0.0).alias("temperature"),
    ))


def off_scale_note(target_max_rpm="target_max") -> Column:
    """Note shown when the target peak is drawn off-scale."""
    from rampstat.functions.rates import report_round
    return F.format_string("Target peak: %.2f RPM (off-scale)", report_round(_c(target_max_rpm), 2))
