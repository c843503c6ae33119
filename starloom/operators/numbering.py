"""Exact positions within groups that never gather an unbounded group in one task."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.scratch import staged

HOT_GROUP_ROWS = 1_000_000
COPIES_PER_TASK = 1_000_000
RUN = 8


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    """NULL-safe equality of ``keys`` with their ``prefix``-ed namesakes on the right."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[prefix + key])
    return condition


def _renamed_keys(df: DataFrame, keys: Sequence[str], prefix: str, *others: str) -> DataFrame:
    return df.select(*[F.col(k).alias(prefix + k) for k in keys], *others)


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    spread: Column,
    name: str,
    hot_rows: int = HOT_GROUP_ROWS,
    copies_per_task: int = COPIES_PER_TASK,
    spread_bits: int = 64,
) -> DataFrame:
    """Add ``name``: the 1-based position of each row in its key group, by ``spread`` then by all columns.

    The order covers every column, so only exact copies tie and the set of results depends on the
    data alone. ``spread`` is an even hash of the row, a signed integer of 64 bits or an unsigned one of fewer
    ``spread_bits``. A group of more than ``hot_rows`` rows is cut into ranges of it, the more the larger the group;
    they are numbered apart and shifted by the size of those before, so the positions do not depend on the cut. Exact copies inside such a group travel as one row with a count until the very end. Group sizes are
    counted, and the rows of such groups written out, when this is called.
    """
    columns = df.columns
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows)
    # Written out, so that the planner knows how few they are and broadcasts them only then.
    hot = staged(_renamed_keys(sizes, keys, "_hot_", "_rows"), "hot-keys")
    if hot.isEmpty():
        in_order = Window.partitionBy(*keys).orderBy(spread, *columns)
        return df.withColumn(name, F.row_number().over(in_order).cast("long"))
    is_hot = same_key(df, hot, keys, "_hot_")
    plain = df.join(hot, is_hot, "left_anti")
    plain = plain.withColumn(
        name, F.row_number().over(Window.partitionBy(*keys).orderBy(spread, *columns)).cast("long")
    )
    in_cells = df.join(hot, is_hot).select(*columns, cell(spread, hot_rows, spread_bits))
    runs = runs_in_cells(packed(in_cells), keys, spread, copies_per_task)
    return plain.unionByName(one_by_one(runs, name))


def cell(spread: Column, hot_rows: int, spread_bits: int = 64) -> Column:
    """``_cell``: the range of ``spread`` a row of a group of ``_rows`` is numbered in; one range up to ``hot_rows``."""
    # A quarter of ``hot_rows`` in a cell, so that an uneven one stays below it.
    bits = F.ceil(F.log2(F.col("_rows") / max(hot_rows, 1))).cast("int") + 2
    bits = F.least(bits, F.lit(spread_bits))
    shifted = F.call_function("shiftright", spread.cast("long"), F.lit(spread_bits) - bits)
    return F.when(F.col("_rows") > hot_rows, shifted).otherwise(F.lit(0).cast("long")).alias("_cell")


def packed(df: DataFrame) -> DataFrame:
    """Exact copies as one row with their number, ``_copies``."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))


def runs_in_cells(
    rows: DataFrame, keys: Sequence[str], spread: Column, copies_per_task: int = COPIES_PER_TASK
) -> DataFrame:
    """``packed`` rows with their ``_cell``, as runs: ``_first`` is the position of the first copy, ``_run`` their number.

    A run has at most ``RUN`` copies: whoever joins runs moves a row per run, and is never told of a hot key less than
    an eighth of its rows. The rows are written once, since the sizes of the cells are taken from them first.
    """
    columns = [c for c in rows.columns if c not in ("_cell", "_copies")]
    # A struct compares NULLs as any value, so one shuffle by it serves both the numbering and the join.
    rows = staged(rows, "packed-rows").withColumn("_group", F.struct(*keys))
    preceding = (Window.unboundedPreceding, -1)
    cells = rows.groupBy("_group", "_cell").agg(F.sum("_copies").alias("_size"))
    shift = F.sum("_size").over(Window.partitionBy("_group").orderBy("_cell").rowsBetween(*preceding))
    shifts = cells.select("_group", "_cell", F.coalesce(shift, F.lit(0)).alias("_shift"))
    in_cell = Window.partitionBy("_group", "_cell").orderBy(spread, *columns).rowsBetween(*preceding)
    placed = rows.withColumn("_before", F.coalesce(F.sum("_copies").over(in_cell), F.lit(0)))
    placed = placed.join(shifts, ["_group", "_cell"])
    first = F.col("_shift") + F.col("_before") + 1

    # One packed row may stand for billions: deal out its copies in bounded blocks, over all tasks if there are several.
    last_block = F.floor((F.col("_copies") - 1) / F.lit(copies_per_task)).cast("long")
    block = F.explode(F.sequence(F.lit(0).cast("long"), last_block)).alias("_block")
    blocks = placed.select(*columns, first.alias("_first"), "_copies", block)
    if not rows.filter(F.col("_copies") > copies_per_task).isEmpty():
        blocks = blocks.repartition("_first", "_block")
    start = F.col("_block") * copies_per_task
    stop = F.least(start + copies_per_task, F.col("_copies")) - 1
    at = F.explode(F.sequence(start, stop, F.lit(RUN).cast("long"))).alias("_at")
    runs = blocks.select(*columns, "_first", stop.alias("_stop"), at)
    size = F.least(F.lit(RUN).cast("long"), F.col("_stop") - F.col("_at") + 1)
    return runs.select(*columns, (F.col("_first") + F.col("_at")).alias("_first"), size.alias("_run"))


def one_by_one(runs: DataFrame, name: str) -> DataFrame:
    """Runs as a row per copy, with its position as ``name``."""
    position = F.explode(F.sequence("_first", F.col("_first") + F.col("_run") - 1)).alias(name)
    return runs.select(*[c for c in runs.columns if c not in ("_first", "_run")], position)
