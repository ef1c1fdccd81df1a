"""Rule-based classifications: customer segment, health status, review flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vendastat.functions.numeric import known

# Operating targets, and the limits of the health rule.
ON_TIME_TARGET = 90.0
RATING_TARGET = 4.0
RETURNING_SHARE_TARGET = 30.0
MONTH_1_RETENTION_TARGET = 20.0
STATUS_FLOORS = [("Strong", 0.80), ("Stable", 0.50), ("Watch closely", 0.25)]
STATUS_ELSE = "At risk"
STATUS_UNCHECKED = "Stable"

# RFM segments, first match wins; each score as (lowest, highest).
SEGMENTS = [
    ("Champions", {"r": (4, 5), "f": (4, 5), "m": (4, 5)}),
    ("Loyal Customers", {"r": (3, 5), "f": (3, 5), "m": (3, 5)}),
    ("Promising / New", {"r": (4, 5), "f": (1, 2)}),
    ("At Risk", {"r": (1, 2), "f": (3, 5), "m": (3, 5)}),
    ("Lost / Hibernating", {"r": (1, 2), "f": (1, 2)}),
    ("Big Spenders", {"m": (4, 5)}),
]
SEGMENT_ELSE = "Need Attention"


def rfm_segment(r: Column, f: Column, m: Column) -> Column:
    """Segment name of a score triple."""
    scores = {"r": r, "f": f, "m": m}
    out = None
    for name, ranges in SEGMENTS:
        hit = reduce(Column.__and__, [scores[s].between(*limits) for s, limits in ranges.items()])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(SEGMENT_ELSE)


def health_status(
    on_time_pct: Column | None = None,
    avg_rating: Column | None = None,
    returning_share: Column | None = None,
    m1_retention: Column | None = None,
) -> Column:
    """Status from the share of targets met; unknown values are left out of the count.

    On-time values up to 1 are read as 0-1 shares. Works per row, so it gives one status
    per month, seller, state or for a one-row bundle.
    """
    checks = []
    if on_time_pct is not None:
        pct = known(on_time_pct.cast("double"))
        checks.append(F.when(pct <= 1.0, pct * 100).otherwise(pct) >= ON_TIME_TARGET)
    for value, target in (
        (avg_rating, RATING_TARGET),
        (returning_share, RETURNING_SHARE_TARGET),
        (m1_retention, MONTH_1_RETENTION_TARGET),
    ):
        if value is not None:
            checks.append(known(value.cast("double")) >= target)
    if not checks:
        return F.lit(STATUS_UNCHECKED)
    made = reduce(Column.__add__, [c.isNotNull().cast("int") for c in checks])
    met = reduce(Column.__add__, [F.coalesce(c.cast("int"), F.lit(0)) for c in checks])
    score = met / F.nullif(made, F.lit(0))
    out = F.when(made == 0, STATUS_UNCHECKED)
    for name, floor in STATUS_FLOORS:
        out = out.when(score >= floor, name)
    return out.otherwise(STATUS_ELSE)


def needs_review(
    on_time_pct: Column,
    avg_rating: Column,
    on_time_target: float = ON_TIME_TARGET,
    rating_target: float = RATING_TARGET,
) -> Column:
    """True if a known value misses its target; an unknown value never flags."""
    return F.coalesce(known(on_time_pct.cast("double")) < on_time_target, F.lit(False)) | F.coalesce(
        known(avg_rating.cast("double")) < rating_target, F.lit(False)
    )
