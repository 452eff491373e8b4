"""Day arithmetic that does not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(later: Column, earlier: Column) -> Column:
    """Whole elapsed days, floored (so -1 for one hour before), NULL if either side is."""
    calendar = F.datediff(later, earlier)
    rolled = earlier + F.make_dt_interval(calendar)
    return calendar - (later < rolled).cast("int")


def calendar_days(later: Column, earlier: Column) -> Column:
    """Number of midnights between two timestamps."""
    return F.datediff(later, earlier)


def ntz(literal: str) -> Column:
    """A timestamp literal without time zone."""
    return F.expr(f"TIMESTAMP_NTZ '{literal}'")


def iso_date(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")
