"""Exact global NTILE without a global sort.

NTILE over one ordering is decided by its ``buckets - 1`` boundary rows. Limits cut an ordering into cells, and an exact
count of each cell says which cells hold boundaries. A bounded sample of those proposes closer limits. The sample only
steers; a bad one costs another round, never a wrong answer. A round is two scans of one written table for all
boundaries of all orderings and narrows a cell some twentyfold, so ten billion rows take four; nothing large is ever shuffled.
The number of boundaries changes neither the number of scans nor the rows that the driver sees.
"""

import json
import math
from bisect import bisect_left
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.scratch import staged

SAMPLE_ROWS = 10_000
# Sampled rows in a round, shared by all cells, and the fewest of a cell that still narrow it. Cells beyond that wait a round.
SAMPLE_BUDGET = 100_000
LEAST_SAMPLE = 200
FINISH_ROWS = 250_000
# Sampled positions stray by about sqrt(sample) / 2; four times that almost always still brackets.
SLACK = 2.0
# So many limits are compared one by one, in generated code; more by a binary search.
FEW_LIMITS = 16


@dataclass
class _Search:
    """The searched positions of one ordering. Cell ``i`` holds the rows above ``limits[i - 1]`` and up to ``limits[i]``."""

    targets: list[int]
    rows: int
    limits: list[tuple]
    up_to: list[int]  # rows up to each limit

    def cells(self) -> dict[int, list[int]]:
        """The searched positions by cell."""
        found: dict[int, list[int]] = {}
        for target in self.targets:
            found.setdefault(bisect_left(self.up_to, target), []).append(target)
        return found

    def below(self, cell: int) -> int:
        return self.up_to[cell - 1] if cell else 0

    def inside(self, cell: int) -> int:
        return (self.up_to[cell] if cell < len(self.limits) else self.rows) - self.below(cell)

    def drop_idle_limits(self) -> None:
        used = sorted({i for cell in self.cells() for i in (cell - 1, cell) if 0 <= i < len(self.limits)})
        self.limits, self.up_to = [self.limits[i] for i in used], [self.up_to[i] for i in used]


def _in_order(key: tuple) -> list:
    """Sorts keys as Spark does: NULL first, NaN last."""
    return [(v is not None, v != v, v) for v in key]


def bucket_ends(rows: int, buckets: int) -> list[int]:
    """Last position of every bucket but the final one; the first ``rows % buckets`` get one row more."""
    size, larger = divmod(rows, buckets)
    ends = [b * size + min(b, larger) for b in range(1, buckets)]
    return [end for end in ends if end < rows]


class _Key:
    """Comparable struct over the ordering columns; Spark orders NULLs first within it."""

    def __init__(self, columns: Sequence[str], schema: StructType):
        self.columns = list(columns)
        self.types = {c: schema[c].dataType for c in self.columns}

    def of_row(self) -> Column:
        return F.struct(*self.columns)

    def literal(self, value: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(self.types[c]).alias(c) for c, v in zip(self.columns, value)])

    def _array(self, values: Sequence[tuple]) -> Column:
        """Many keys as one literal, which the planner folds once."""
        texts = [{c: None if v is None else str(v) for c, v in zip(self.columns, value)} for value in values]
        fields = [(c, t.simpleString()) for c, t in self.types.items()]
        as_texts = ", ".join(f"`{c}`: string" for c, _ in fields)
        typed = ", ".join(f"`{c}`: {t}" for c, t in fields)
        return F.from_json(F.lit(json.dumps(texts)), f"array<struct<{as_texts}>>").cast(f"array<struct<{typed}>>")

    def as_text(self) -> Column:
        return F.array(*[F.col(c).cast("string") for c in self.columns])

    def cell(self, limits: Sequence[tuple]) -> Column:
        """How many of the ascending ``limits`` lie below the row."""
        row = self.of_row()
        if len(limits) <= FEW_LIMITS:
            return reduce(lambda n, limit: n + (row > self.literal(limit)).cast("int"), limits, F.lit(0))
        array, steps = self._array(limits), [1 << i for i in range(len(limits).bit_length() - 1, -1, -1)]
        return F.aggregate(
            F.array(*[F.lit(step) for step in steps]),
            F.lit(0),
            lambda n, step: n
            + F.when((n + step <= len(limits)) & (F.try_element_at(array, n + step) < row), step).otherwise(0),
        )


def ntile_columns(
    df: DataFrame,
    orderings: Mapping[str, Sequence[str]],
    buckets: int,
    sample_rows: int = SAMPLE_ROWS,
    finish_rows: int = FINISH_ROWS,
) -> DataFrame:
    """Add one 1..``buckets`` column per ordering (ascending, NULLs first), as ``ntile`` would.

    An ordering must tell all rows apart, so it ends with a unique tiebreak. Sort descending by passing a
    column that ascends the other way. ``df`` is written once to the shared scratch folder, and the boundaries
    are searched, when this is called.
    """
    table = staged(df, "ntile")
    keys = {name: _Key(columns, table.schema) for name, columns in orderings.items()}
    rows = table.count()
    searches = {name: _Search(bucket_ends(rows, buckets), rows, [], []) for name in orderings}
    while wide := [(name, c) for name, s in searches.items() for c in s.cells() if s.inside(c) > finish_rows]:
        _narrow(table, keys, searches, wide[: SAMPLE_BUDGET // LEAST_SAMPLE], sample_rows)
    found = _boundary_rows(table, keys, searches, rows > finish_rows)
    return table.select("*", *[(key.cell(found[name]) + 1).alias(name) for name, key in keys.items()])


def _narrow(
    table: DataFrame, keys: Mapping[str, _Key], searches: Mapping[str, _Search], wide: list[tuple[str, int]], sample_rows: int
) -> None:
    """One scan to sample the ``wide`` cells, one to count the cells between old and proposed limits."""
    samples = _sorted_samples(table, keys, searches, wide, sample_rows)
    proposed: dict[str, set[tuple]] = {}
    for (name, cell), sample in samples.items():
        for target in searches[name].cells()[cell]:
            proposed.setdefault(name, set()).update(_proposed_limits(sample, target, searches[name], cell))
    limits = {name: sorted({*searches[name].limits, *new}, key=_in_order) for name, new in proposed.items()}
    if not limits:
        return
    cells = [F.struct(F.lit(name).alias("name"), keys[name].cell(own).alias("cell")) for name, own in limits.items()]
    counted = table.select(F.explode(F.array(*cells)).alias("of")).groupBy("of").count().collect()
    sizes = {(r["of"]["name"], r["of"]["cell"]): r["count"] for r in counted}
    for name, own in limits.items():
        search = searches[name]
        search.limits, search.up_to = own, list(accumulate(sizes.get((name, i), 0) for i in range(len(own))))
        search.drop_idle_limits()


def _sorted_samples(
    table: DataFrame, keys: Mapping[str, _Key], searches: Mapping[str, _Search], wide: list[tuple[str, int]], sample_rows: int
) -> dict[tuple[str, int], list[tuple]]:
    """Keys from each cell, about ``sample_rows`` a boundary, fewer if ``SAMPLE_BUDGET`` asks for it, all taken in one scan."""
    chosen = []
    for name in {name: None for name, _ in wide}:
        search, inside = searches[name], {}
        for cell, targets in search.cells().items():
            if (name, cell) in wide:
                wanted = min(sample_rows * len(targets), max(LEAST_SAMPLE, SAMPLE_BUDGET // len(wide)))
                inside[cell] = wanted / search.inside(cell)
        parts = F.array(*[F.lit(inside.get(cell, 0.0)) for cell in range(len(search.limits) + 1)])
        cell = keys[name].cell(search.limits)
        of = F.struct(F.lit(name).alias("name"), cell.alias("cell"))
        chosen.append(F.when(F.rand() < F.element_at(parts, cell + 1), of))
    columns = sorted({c for name, _ in wide for c in keys[name].columns})
    taken = table.select(F.explode(F.array_compact(F.array(*chosen))).alias("_of"), *columns).collect()
    samples: dict[tuple[str, int], list[tuple]] = {}
    for row in taken:
        name = row["_of"]["name"]
        samples.setdefault((name, row["_of"]["cell"]), []).append(tuple(row[c] for c in keys[name].columns))
    for (name, _), sample in samples.items():
        sample.sort(key=_in_order)
        if len(sample) > 1 and sample[0] == sample[-1]:
            raise ValueError(f"{keys[name].columns} does not tell all rows apart: add a unique tiebreak")
    return samples


def _proposed_limits(sample: list[tuple], target: int, search: _Search, cell: int) -> list[tuple]:
    """Two sampled keys expected to enclose the searched row."""
    middle = (target - search.below(cell)) / search.inside(cell) * len(sample)
    slack = SLACK * math.sqrt(len(sample)) + 1
    return [sample[max(0, int(middle - slack))], sample[min(len(sample) - 1, int(middle + slack))]]


def _boundary_rows(
    table: DataFrame, keys: Mapping[str, _Key], searches: Mapping[str, _Search], write: bool
) -> dict[str, list[tuple]]:
    """The searched rows of each ordering in order, picked from cells whose row count is known to be small."""
    held = {name: search.cells() for name, search in searches.items() if search.targets}
    found: dict[str, list[tuple]] = {name: [] for name in searches}
    if not held:
        return found
    near = table
    if write:
        in_reach = [keys[name].cell(searches[name].limits).isin(*cells) for name, cells in held.items()]
        near = staged(table.filter(reduce(Column.__or__, in_reach)), "ntile-boundaries")
    picks = []
    for name, cells in held.items():
        key, search = keys[name], searches[name]
        in_order = Window.partitionBy("_cell").orderBy(key.of_row())
        before = F.element_at(F.array(*[F.lit(search.below(c)).cast("long") for c in range(len(search.limits) + 1)]), F.col("_cell") + 1)
        # All rows that tie with one of a cell are in it: if the next does not, as many rows lie up to this one as it says.
        tied = F.coalesce(F.lead(key.of_row()).over(in_order) == key.of_row(), F.lit(False))
        picks.append(
            near.withColumn("_cell", key.cell(search.limits))
            .filter(F.col("_cell").isin(*cells))
            .select(
                F.lit(name).alias("name"),
                key.as_text().alias("boundary"),
                (F.row_number().over(in_order) + before).alias("position"),
                tied.alias("tied"),
            )
            .filter(F.col("position").isin(*search.targets))
        )
    for row in sorted(reduce(DataFrame.unionAll, picks).collect(), key=lambda r: r["position"]):
        if row["tied"]:
            raise ValueError(f"{keys[row['name']].columns} does not tell all rows apart: add a unique tiebreak")
        found[row["name"]].append(tuple(row["boundary"]))
    return found
