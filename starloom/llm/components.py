"""Connected components by alternating stars, without gathering a component anywhere."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.scratch import staged


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``links`` (long columns ``a``, ``b``).

    Each round ties all larger neighbours of a node to its smallest one, then the node and its smaller neighbours
    likewise, until every component is a star. Rounds grow with the logarithm of the component, and a round never
    makes more links than it got. A node with very many links is a skewed key of a join, which adaptive
    execution splits; minima are aggregated before the shuffle. Every round is a written table.

    Links may repeat, point either way, or tie a node to itself (which only names the node). Links with a null end
    are left out. No links give no rows.
    """
    named = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL")
    current = staged(named.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    shape = None
    while True:
        large = _stars(current.unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b"))), label, "large")
        current = _stars(large, label, "small")
        last, shape = shape, current.agg(
            F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if shape == last:
            break
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.filter("a <> b").select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        roots.select("node", F.col("node").alias("root"))
    )


def _stars(links: DataFrame, label: str, kind: str) -> DataFrame:
    """One half of a round; ``a >= b`` in every link it gives."""
    smallest = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    smallest = staged(smallest.select(F.col("a").alias("at"), "low"), label)
    joined = links.join(smallest, F.col("a") == F.col("at"))
    moved = joined.filter("b > a" if kind == "large" else "b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    # In a large star a node keeps no link of its own; only one that is its own smallest must stay named.
    own = smallest.select(F.col("at").alias("a"), F.col("low").alias("b"))
    own = own.filter("a = b") if kind == "large" else own
    return staged(moved.unionAll(own).distinct(), label)
