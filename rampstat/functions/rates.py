"""Rate arithmetic and rate text.

Rates are stored canonically in requests per second; ``unit`` only changes
how a value is displayed. Rounding is half-even (``bround``) like the
reporting code it mirrors; text formatting rounds first, then formats, so
``%.2f`` never applies its own half-up rule to a tie.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rampstat.schema import MIN_ELAPSED_S, MIN_RATE_RPS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _unit(unit) -> Column:
    """Accept a column name, a Column, or a literal 'rps'/'rpm'."""
    if isinstance(unit, str) and unit.lower() in ("rps", "rpm"):
        return F.lit(unit.lower())
    return F.lower(_c(unit))


def display_to_rps(value, unit) -> Column:
    """Slider / display value to canonical RPS."""
    return F.when(_unit(unit) == "rpm", _c(value) / F.lit(60.0)).otherwise(_c(value).cast("double"))


def rps_to_display(rps, unit) -> Column:
    """Canonical RPS to the display value of ``unit``."""
    return F.when(_unit(unit) == "rpm", _c(rps) * F.lit(60.0)).otherwise(_c(rps))


def unit_label(unit) -> Column:
    return F.upper(_unit(unit))


def rps_to_display_int(rps, unit) -> Column:
    """RPS back to the integer display value (half-even)."""
    return F.rint(rps_to_display(rps, unit)).cast("int")


def column_suffix(unit: str) -> str:
    """Column-name suffix, decided when the plan is built."""
    return "rpm" if str(unit).lower() == "rpm" else "rps"


def format_rate_value(rps, unit) -> Column:
    """B5: '60.0 RPM' or '1.50 RPS'."""
    return F.when(_unit(unit) == "rpm",
                  F.format_string("%.1f RPM", report_round(_c(rps) * F.lit(60.0), 1))
                  ).otherwise(F.format_string("%.2f RPS", report_round(_c(rps), 2)))


def format_rate_conversion(value, unit) -> Column:
    """B6: '30 RPM = 0.50 RPS' / '10 RPS = 10.00 RPS'."""
    v = _c(value)
    return F.when(_unit(unit) == "rpm",
                  F.format_string("%d RPM = %.2f RPS", v.cast("long"),
                                  report_round(v / F.lit(60.0), 2))
                  ).otherwise(F.format_string("%d RPS = %.2f RPS", v.cast("long"),
                                              report_round(v.cast("double"), 2)))


def allocated_rps(base_rps="target_rps", percentage="percentage") -> Column:
    """Rate allocated to a model."""
    return _c(base_rps) * _c(percentage) / F.lit(100.0)


def at_least_elapsed(seconds) -> Column:
    """Elapsed time never below 1 ms."""
    return F.greatest(_c(seconds).cast("double"), F.lit(MIN_ELAPSED_S))


def planned_interval_s(target_rps="target_rps") -> Column:
    """Planned gap between two requests of a stage."""
    return F.lit(1.0) / F.greatest(_c(target_rps), F.lit(MIN_RATE_RPS))


def progress_fraction(stage_index, stage_elapsed_s, stage_duration_s, total_stages) -> Column:
    """Whole-run progress, interpolated within the current stage, capped at 1."""
    within = F.least(_c(stage_elapsed_s) / F.greatest(_c(stage_duration_s), F.lit(MIN_ELAPSED_S)),
                     F.lit(1.0))
    return F.least((_c(stage_index) + within) / F.greatest(_c(total_stages), F.lit(1)),
                   F.lit(1.0))


def rate_delta(achieved, target) -> Column:
    """Achieved minus target."""
    return _c(achieved) - _c(target)


def stage_number(stage_index="stage_index") -> Column:
    """Human stage number."""
    return _c(stage_index) + F.lit(1)


def report_round(x, digits: int) -> Column:
    """Report rounding, half-even on the scaled binary value
    (``rint(x * 10^d) / 10^d``), the same IEEE steps as SQL ``round_even``."""
    scale = float(10 ** digits)
    return F.rint(_c(x) * F.lit(scale)) / F.lit(scale)
