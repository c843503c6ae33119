"""Two layouts of a table, and a filter that no layout spares much of the scan."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.growth import within
from starloom.scratch import scratch_path
from starloom.sources.store import read_table, write_table


def laid_out(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """``df`` rewritten, with or without folders per value of ``partition_by``, and read from there."""
    path = scratch_path(df.sparkSession, "layout")
    write_table(df, path, partition_by)
    return read_table(df.sparkSession, path, df.schema)


def month_totals(fact_order_items: DataFrame, months: tuple[str, str]) -> DataFrame:
    """A filter that keeps nearly everything: no layout can spare much of the scan."""
    kept = fact_order_items.filter(within(F.col("purchase_month"), months))
    return kept.groupBy("purchase_month").agg(
        F.count(F.lit(1)).alias("items"), F.sum("item_total_value").alias("total")
    )
