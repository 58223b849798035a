"""Time expressions over TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(86_400_000_000.0)


def decayed(age_days: Column, half_life: float = 7.0) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * age_days / half_life)


def freshness(now: Column, published: Column) -> Column:
    """Days since publication, 0 at least; -1 where it isn't known."""
    return F.coalesce(F.greatest(F.lit(0.0), days_between(now, published)), F.lit(-1.0))
