"""Completed reporting periods relative to an explicit date."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def week_start(day: Column) -> Column:
    """The Sunday on or before ``day`` (``date_trunc('week')`` would give Monday)."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def completed_weeks(as_of: Column, n: int) -> Column:
    """The last ``n`` finished Sunday-to-Saturday weeks, oldest first."""
    back = F.sequence(F.lit(n), F.lit(1))
    return F.transform(back, lambda i: F.struct(
        F.date_sub(week_start(as_of), i * 7).alias("period_start"),
        F.date_sub(week_start(as_of), i * 7 - 6).alias("period_end"),
    ))


def completed_months(as_of: Column, n: int) -> Column:
    """The last ``n`` finished calendar months, oldest first."""
    back = F.sequence(F.lit(n), F.lit(1))
    first = F.trunc(as_of, "MM")
    return F.transform(back, lambda i: F.struct(
        F.add_months(first, -i).alias("period_start"),
        F.last_day(F.add_months(first, -i)).alias("period_end"),
    ))
