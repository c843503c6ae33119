"""Totals per period, their change and their moving average."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.exact import rounded_mean, rounded_ratio


def within(period: Column, window: tuple[str, str] | None) -> Column:
    """Inclusive on both ends; a NULL period is outside."""
    if window is None:
        return F.lit(True)
    return period.between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date"))


def period_growth(
    df: DataFrame,
    period: str,
    value: str,
    window: tuple[str, str] | None = None,
    frame: int = 3,
) -> DataFrame:
    """``(period, total, change_pct, moving_avg)``, ordered by period.

    Change is against the previous row, across a gap if a period is missing. The average takes up to
    ``frame`` rows and starts with fewer. The unpartitioned window sees one row per period, never data.
    """
    totals = df.filter(within(F.col(period), window)).groupBy(period).agg(F.sum(value).alias("total"))
    by_period = Window.orderBy(F.col(period).asc_nulls_last())
    recent = by_period.rowsBetween(1 - frame, 0)
    before = F.lag("total").over(by_period)
    return totals.select(
        period,
        "total",
        rounded_ratio(F.col("total") - before, before, per=100).alias("change_pct"),
        rounded_mean(F.sum("total").over(recent), F.count("total").over(recent)).alias("moving_avg"),
    ).orderBy(F.col(period).asc_nulls_last())
