"""Best items per group, ties included."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.numbering import same_key


def top_k_per_group(df: DataFrame, group: str, item: str, value: str, k: int = 3) -> DataFrame:
    """``(group, item, value, rank)`` for the items of competition rank at most ``k``; NULL ranks first.

    Input has one row per (group, item). Ranks are worked out on the distinct values of a group, where
    the row-number limit keeps ``k`` rows per group before the shuffle; the items then look their rank up.
    A group of any size, or any number of tied items, is therefore never sorted in one task.
    """
    levels = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_items"))
    best = Window.partitionBy(group).orderBy(F.col(value).desc_nulls_first())
    levels = levels.withColumn("_level", F.row_number().over(best)).filter(F.col("_level") <= k)
    ahead = F.sum("_items").over(best.rowsBetween(Window.unboundedPreceding, -1))
    levels = levels.select(
        F.col(group).alias("_rank_" + group),
        F.col(value).alias("_rank_" + value),
        (F.coalesce(ahead, F.lit(0)) + 1).alias("rank"),
    ).filter(F.col("rank") <= k)
    return df.join(levels, same_key(df, levels, [group, value], "_rank_")).select(group, item, value, "rank")
