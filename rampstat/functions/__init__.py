"""Column expressions. Every function returns a Spark Column
built from built-in expressions, so it stays inside whole-stage codegen."""

from rampstat.functions.outcome import null_to_empty  # noqa: F401
from rampstat.functions.rates import (  # noqa: F401
    allocated_rps, at_least_elapsed, column_suffix, display_to_rps, format_rate_conversion,
    format_rate_value, planned_interval_s, progress_fraction, rate_delta, report_round,
    rps_to_display, rps_to_display_int, stage_number, unit_label,
)
from rampstat.functions.text import (  # noqa: F401
    endpoint_url, endpoint_url_view, off_scale_note, parse_prompt_id, prompt_id, request_payload,
)
