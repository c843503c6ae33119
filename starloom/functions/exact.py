"""Ratios rounded half away from zero without ever leaving integer arithmetic.

Decimal division in Spark rounds once at its result scale and a following ``round`` rounds again, so
a quotient just below a half cent could go up. Here the quotient is taken once, over integers.
"""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = "decimal(38,0)"


def _two_places(hundredths: Column, precision: int) -> Column:
    whole = hundredths.cast(f"decimal({precision},0)")
    return (whole * F.lit(Decimal("0.01"))).cast(f"decimal({precision},2)")


def rounded_ratio(numerator: Column, denominator: Column, per: int = 1) -> Column:
    """``per * numerator / denominator`` to two places, for inputs of at most two decimals.

    NULL when either side is NULL; a zero denominator fails under ANSI mode, as it should.
    """
    top = F.abs((numerator * F.lit(100)).cast(WHOLE)) * F.lit(2 * 100 * per)
    bottom = F.abs((denominator * F.lit(100)).cast(WHOLE))
    dividend, divisor = top + bottom, bottom * F.lit(2)
    # Not ``div``: on decimals it returns a long and wraps around in silence.
    hundredths = (dividend - dividend % divisor) / divisor
    negative = (numerator < F.lit(0)) != (denominator < F.lit(0))
    return _two_places(F.when(negative, -hundredths).otherwise(hundredths), 30)


def rounded_mean(total: Column, count: Column) -> Column:
    """Mean of ``count`` values adding up to ``total``; NULL when there are none."""
    return rounded_ratio(total, F.nullif(count, F.lit(0)))


def rounded_days(micros: Column) -> Column:
    """Microseconds as days with two decimals; long arithmetic, since this runs once per row."""
    day = 86_400_000_000
    whole, rest = F.call_function("div", F.abs(micros), F.lit(day)), F.abs(micros) % F.lit(day)
    # Whole days apart, so that the most distant dates stay within the range of a long.
    hundredths = whole * 100 + F.call_function("div", rest * F.lit(200) + F.lit(day), F.lit(2 * day))
    return _two_places(F.when(micros < 0, -hundredths).otherwise(hundredths), 12)
