"""Label ladders, calendar names and hour buckets.

A ladder is an ordered list of rungs ``(op, bound, label)`` evaluated top
down, plus a default; ``ladder()`` turns it into one chained ``CASE WHEN``
column, so every labelling step stays a JVM expression inside whole-stage
codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.functions.numeric import as_col

Rung = tuple[str, float | None, str]

_OPS = {
    "<=": lambda x, b: x <= b,
    "<": lambda x, b: x < b,
    ">=": lambda x, b: x >= b,
    ">": lambda x, b: x > b,
    "==": lambda x, b: x == b,
    "isnull": lambda x, b: x.isNull(),
}


def ladder(x: Column | str, rungs: Sequence[Rung], default: str) -> Column:
    """Chained ``when`` over ``rungs``; first true rung wins, else ``default``."""
    x = as_col(x)
    out = None
    for op, bound, label in rungs:
        cond = _OPS[op](x, F.lit(bound) if bound is not None else None)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


# ---------------------------------------------------------------------------
# Thresholds and label texts that results must reproduce
# exactly. Each ladder is listed top-down as (operator, bound, label), then
# its default label.
# ---------------------------------------------------------------------------

SYMMETRY = ([("<=", 5, "Symmetric"), ("<=", 15, "Mildly Asymmetric")], "Strongly Asymmetric")
RECOVERY = (
    [(">=", 10, "Strong Recovery"), (">=", 0, "Slight Recovery"), (">=", -10, "Slight Worsening")],
    "Strong Worsening",
)
CONSISTENCY = ([("<=", 20, "Highly Consistent"), ("<=", 30, "Moderately Consistent")], "Inconsistent")
AIRLINE_TREND = (
    [
        ("isnull", None, "First Month (no prior)"),
        ("<=", -10, "Strong Improvement"),
        ("<", 0, "Slight Improvement"),
        ("<=", 10, "Slight Worsening"),
    ],
    "Strong Worsening",
)
OVERALL_TREND = ([("<=", -2, "Overall Improving"), (">=", 2, "Overall Worsening")], "Stable")
SEVERITY = (
    [(">=", 40, "Critical"), (">=", 30, "High Severity"), (">=", 20, "Moderate Severity")],
    "Low Severity",
)
HOUR_RISK = ([(">=", 40, "Very High Risk"), (">=", 30, "High Risk"), (">=", 20, "Moderate Risk")], "Low Risk")
MONTH_TREND = (
    [
        ("isnull", None, "Baseline"),
        ("<=", -5, "Strong Improvement"),
        ("<", 0, "Slight Improvement"),
        ("<=", 5, "Slight Worsening"),
    ],
    "Strong Worsening",
)
TREND_POSITION = ([(">", 5, "Above Trend"), ("<", -5, "Below Trend")], "On Trend")
IMPACT = (
    [(">=", 30, "Dominant Cause"), (">=", 20, "Major Cause"), (">=", 10, "Moderate Cause")],
    "Minor Cause",
)
CONCENTRATION = ([(">=", 50, "Highly Concentrated"), (">=", 40, "Moderately Concentrated")], "Distributed")

# Two-axis labels: (both good, only first good, only second good, neither).
PERFORMANCE_LABELS = ("Best Overall", "Consistent but Slow", "Fast but Unpredictable", "Standard")
AIRPORT_PROFILE_LABELS = ("Busy & Delayed", "Busy but Punctual", "Quiet but Chaotic", "Standard")
SPREAD_LABELS = ("Wide & Severe", "Wide but Mild", "Narrow but Severe", "Narrow & Mild")
NETWORK_LABELS = ("Follows Network Pattern", "Deviates from Network")
NETWORK_CAUSE = "Late Aircraft Delay"

# Departure vs arrival profile against the global averages (strict ">").
DELAY_PROFILE_LABELS = {
    "ground_ops": "High Dep / Normal Arr : Ground Ops Problem",
    "destination": "Normal Dep / High Arr : Destination Congestion",
    "systemic": "High Both : Systemic Problem",
    "normal": "Normal Both : Well Performing",
}
# The reference's rank step compares against this spelling, which never
# matches the produced label (so its rank column is always NULL).
GROUND_OPS_LITERAL_TYPO = "High Dep / Normal Arr → Ground Ops Problem"
DELAY_PROFILE_ORDER = ("ground_ops", "systemic", "destination", "normal")

RECOVERY_CATEGORIES = ("Best Recovering", "Worst Recovering")

# Delay buckets in minutes (inclusive BETWEEN; values in (30, 31) fall in none).
MILD_BUCKET = (15, 30)
MODERATE_BUCKET = (31, 60)
SEVERE_ABOVE = 60

# Hour of day -> part of day, inclusive ranges, else the default.
TIME_OF_DAY = [
    (5, 8, "Early Morning"),
    (9, 11, "Mid Morning"),
    (12, 14, "Afternoon"),
    (15, 17, "Peak Hours"),
    (18, 20, "Evening"),
]
TIME_OF_DAY_DEFAULT = "Night / Red Eye"

MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

SEASONS = [((12, 1, 2), "Winter"), ((3, 4, 5), "Spring"), ((6, 7, 8), "Summer")]
SEASON_DEFAULT = "Fall"

ROUTE_ARROW = " → "

# Performance tier colouring (cut-offs are not published, so they are parameters).
RAG_LABELS = ("Green", "Amber", "Red")
# ---------------------------------------------------------------------------


def lbl(x: Column | str, spec: tuple[list[Rung], str]) -> Column:
    rungs, default = spec
    return ladder(x, rungs, default)


def two_axis(first_ok: Column, second_ok: Column, labels: Sequence[str]) -> Column:
    both, only_first, only_second, neither = labels
    return (
        F.when(first_ok & second_ok, F.lit(both))
        .when(first_ok & ~second_ok, F.lit(only_first))
        .when(~first_ok & second_ok, F.lit(only_second))
        .otherwise(F.lit(neither))
    )


def month_name(m: Column | str) -> Column:
    m = as_col(m)
    out = None
    for i, name in enumerate(MONTH_NAMES, start=1):
        out = F.when(m == i, F.lit(name)) if out is None else out.when(m == i, F.lit(name))
    return out


def season(m: Column | str) -> Column:
    m = as_col(m)
    out = None
    for months, name in SEASONS:
        cond = m.isin(*months)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(SEASON_DEFAULT))


def time_of_day(h: Column | str) -> Column:
    h = as_col(h)
    out = None
    for lo, hi, name in TIME_OF_DAY:
        cond = h.between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(TIME_OF_DAY_DEFAULT))


def route(origin: Column | str, dest: Column | str) -> Column:
    """``origin → dest``; NULL if either end is NULL (like SQL ``||``)."""
    return F.concat(as_col(origin), F.lit(ROUTE_ARROW), as_col(dest))


def rag(x: Column | str, amber: float, red: float, higher_is_worse: bool = True) -> Column:
    """Red/Amber/Green tier of a metric with caller-chosen cut-offs."""
    green, amber_l, red_l = RAG_LABELS
    x = as_col(x)
    if higher_is_worse:
        return F.when(x >= red, F.lit(red_l)).when(x >= amber, F.lit(amber_l)).otherwise(F.lit(green))
    return F.when(x <= red, F.lit(red_l)).when(x <= amber, F.lit(amber_l)).otherwise(F.lit(green))
