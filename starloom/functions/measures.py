"""Measures derived while building the facts. All are NULL when an input is NULL.

Timestamps carry no zone, and nothing here may pass through one: ``date_trunc`` and ``timestampdiff`` would
turn them into instants of the session zone, where a day can lack its midnight or last 23 hours.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from starloom.functions.exact import rounded_days


def calendar_day(ts: Column) -> Column:
    return F.to_date(ts)


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def has_time_of_day(ts: Column) -> Column:
    return calendar_day(ts).cast("timestamp_ntz") != ts


def elapsed_days(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end``, two decimals."""
    gap = end - start

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), gap).cast("long")

    seconds = F.extract(F.lit("SECOND"), gap)
    whole_minutes = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
    return rounded_days(whole_minutes * 60_000_000 + (seconds * 1_000_000).cast("long"))


def days_late(actual: Column, promised: Column) -> Column:
    """Whole calendar days after the promise; arriving any time on the promised day is 0."""
    return F.datediff(calendar_day(actual), calendar_day(promised))


def is_late(actual: Column, promised: Column) -> Column:
    return calendar_day(actual) > calendar_day(promised)


def month_ordinal(day: Column) -> Column:
    """Months since year 0, so that a difference of two ordinals is a number of months."""
    return F.year(day) * F.lit(12) + F.month(day)
