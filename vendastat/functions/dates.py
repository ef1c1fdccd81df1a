"""Month and day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(ts: Column) -> Column:
    """First day of the month of a timestamp, as a date."""
    return F.trunc(ts, "MM")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole 24-hour days between two timestamps (not the number of midnights crossed)."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def months_between_starts(later: Column, earlier: Column) -> Column:
    """Number of months between two first-of-month dates."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
