"""Share of flagged rows and averages per band."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.exact import rounded_mean, rounded_ratio


def rate_by_dimension(
    facts: DataFrame, dimension: DataFrame, key: str, label: str, flag: Column
) -> DataFrame:
    """``(label, flagged, rows, rate_pct)`` per ``label`` of the dimension, highest rate first.

    A NULL flag stays in the denominator; facts without a dimension row are dropped. Facts are reduced to
    one row per key before they meet the dimension, on the partitioning the join needs anyway.
    """
    per_key = facts.groupBy(key).agg(
        F.sum(F.when(flag, 1).otherwise(0)).alias("_flagged"), F.count(F.lit(1)).alias("_rows")
    )
    return (
        per_key.join(dimension.select(key, label), key)
        .groupBy(label)
        .agg(F.sum("_flagged").alias("flagged"), F.sum("_rows").alias("rows"))
        .withColumn("rate_pct", rounded_ratio(F.col("flagged"), F.col("rows"), per=100))
        .orderBy(F.col("rate_pct").desc_nulls_first(), label)
    )


def banded_average(
    df: DataFrame, bands: Sequence[tuple[Column, str]], last_band: str, value: str
) -> DataFrame:
    """``(band, rows, avg_value)``: the first band whose condition holds takes the row, else ``last_band``."""
    (condition, name), *others = bands
    band = F.when(condition, name)
    for condition, name in others:
        band = band.when(condition, name)
    # Each task sends one row per band, so a single one can merge and sort them.
    return (
        df.groupBy(band.otherwise(last_band).alias("band"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("_total"), F.count(value).alias("_valued"))
        .select("band", "rows", rounded_mean(F.col("_total"), F.col("_valued")).alias("avg_value"))
        .coalesce(1)
        .orderBy("band")
    )
