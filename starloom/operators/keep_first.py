"""One row per key, chosen by a tiebreak."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """The row with the smallest ``tiebreak`` (NULLs last) of every key; rows with a NULL key form one group.

    An aggregate rather than a window: each task keeps one row per key before the shuffle, so a key
    holding a large share of the table costs no more than any other. The remaining columns settle
    what the tiebreak leaves open, so the pick never depends on row order.
    """
    rest = [c for c in df.columns if c not in keys and c not in tiebreak]
    nulls_last = [part for c in tiebreak for part in (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))]
    first = df.groupBy(*keys).agg(F.min(F.struct(*nulls_last, *rest)).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])
