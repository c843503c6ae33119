"""Mixing sources to target weights by Pfair scheduling.

A source of weight ``w`` has blocks 1, 2, ...; block ``i`` may not go before slot ``floor((i - 1) / w)`` and must be
out by slot ``ceil(i / w)``. Taking in every slot the released block with the earliest deadline keeps all of these
dates, so after any number of slots each source has had its share to within less than one block.
"""

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import arrow_schema, running_before, written_in_order
from starloom.scratch import scratch_path, staged

PERIOD = 1000
MAX_SOURCES = 2000  # with a schedule of their own; beyond it half of them, and as many groups of smaller ones
BLOCK_BYTES = 1 << 16
ROWS_AT_ONCE = 1 << 18


def whole_weights(weights: dict) -> dict:
    """Whole numbers in the exact proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    common = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * common) for s, x in exact.items()}


def whole_shares(weights: dict, period: int = PERIOD) -> dict:
    """Whole numbers of slots in a period, in proportion to the weights, at least one each, by largest remainder.

    The period is longer if there are more than a tenth as many sources as slots, so it is ten slots a source or ``period``.
    """
    period = max(period, 10 * len(weights))
    whole = whole_weights(weights)
    total = sum(whole.values())
    shares = {s: max(1, w * period // total) for s, w in whole.items()}
    by_rest = sorted(shares, key=lambda s: (shares[s] * total - whole[s] * period, str(s)))
    for at in range(abs(missing := period - sum(shares.values()))):
        if missing > 0:
            shares[by_rest[at % len(by_rest)]] += 1
        else:
            largest = max(shares, key=lambda s: (shares[s], str(s)))
            shares[largest] -= 1
    return shares


def slots_in_order(shares: dict) -> Iterator[tuple]:
    """One period, slot by slot: (source, number of the source's block from 0), by earliest deadline among the released.

    Every source has an exact whole number of blocks in a period, so the next period begins as this one did. Ties go
    to the source that is first in order.
    """
    period = sum(shares.values())
    waiting = [(0, n, s) for n, s in enumerate(sorted(shares, key=str))]  # (release, order, source)
    done = dict.fromkeys(shares, 0)
    ready: list = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, n, source = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[source] + 1) * period // shares[source]), n, source))
        _, n, source = heapq.heappop(ready)
        yield source, done[source]
        done[source] += 1
        if done[source] < shares[source]:
            heapq.heappush(waiting, (done[source] * period // shares[source], n, source))


def schedule(shares: dict) -> list[tuple]:
    """One period as a list: (slot, source, number of the source's block from 0)."""
    return [(slot, *own) for slot, own in enumerate(slots_in_order(shares))]


def tempered(sizes: dict, temperature: float) -> dict:
    """Target weights from sizes: 1 keeps the sources' own shares, larger temperatures even them out."""
    return {s: max(n, 1) ** (1 / temperature) for s, n in sizes.items()}


def source_blocks(
    docs: DataFrame, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Per row ``id``, ``tie`` (a hash of the text), ``source``, ``size`` (UTF-8 bytes plus 1) and ``block`` of its source.

    Inside a source rows follow a hash of the id; a block begins with each ``block_bytes`` of the running size. Rows are
    sorted into ranges by source and hash, so a source of any size is spread over tasks; the sizes of earlier
    ranges are added from one row per range and source.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.md5(F.col(id_col).cast("string").cast("binary")).alias("spread"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("source", "spread", "id", "tie")]
    ranges = written_in_order(rows, order, "pfair-order")
    schema = "id {}, tie bigint, source string, size bigint, part bigint, inside bigint"
    schema = schema.format(ranges.schema["id"].dataType.simpleString())
    out_schema = arrow_schema(schema)

    def run_up(batches):
        at = (None, None, 0)
        for batch in batches:
            before = []
            for part, source, size in zip(*(batch.column(c).to_pylist() for c in ("part", "source", "size")), strict=True):
                if (part, source) != at[:2]:
                    at = (part, source, 0)
                before.append(at[2])
                at = (part, source, at[2] + size)
            kept = [batch.column(c) for c in ("id", "tie", "source", "size", "part")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.int64())], schema=out_schema)

    # One range is one task's sorted rows; they are sorted again as files may be read in other parts.
    sorted_again = ranges.repartition("part").sortWithinPartitions("part", "place")
    inside = sorted_again.select("id", "tie", "source", "size", "part").mapInArrow(run_up, schema)
    sums = ranges.groupBy("part", "source").agg(F.sum("size").alias("n"))
    sums = staged(running_before(sums, "n", "before", ["part"], ["source"]), "pfair-ranges")
    sums = sums.select(F.col("part").alias("p"), F.col("source").alias("s"), "before")
    joined = inside.join(sums, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    block = F.floor((F.col("before") + F.col("inside")) / F.lit(block_bytes)).cast("long")
    return joined.select("id", "tie", "source", "size", block.alias("block"))


def period_table(spark: SparkSession, shares: dict) -> DataFrame:
    """``source``, ``share``, ``nth`` and ``slot``: one period, a row per slot."""
    rows = [(source, shares[source], nth, slot) for slot, source, nth in schedule(shares)]
    return spark.createDataFrame(rows, "period_source string, share long, nth long, period_slot long")


def _scheduled(
    docs: DataFrame, weights: dict | None, temperature: float, block_bytes: int, columns: tuple, most: int
) -> tuple[DataFrame, dict, dict]:
    """The written ``source_blocks`` with ``entry`` and ``nth_of_entry``, and by entry of the schedule its blocks and its weight.

    An entry is a source, ``nth_of_entry`` the number of its block. Of more than ``most`` sources the half of largest
    weight are entries; the others share the other half, by a hash of their names. Inside such an entry blocks follow each other by
    (number + 1) / weight of their sources: wherever it is cut there is a factor for which every source has had as many blocks as its
    weight times the factor, to within less than one, or all it has.
    """
    blocks = staged(source_blocks(docs, block_bytes, *columns), "pfair-blocks")
    spark = docs.sparkSession
    sizes = blocks.groupBy("source").agg(F.sum("size").alias("bytes"), F.ceil(F.sum("size") / block_bytes).alias("blocks"))
    sizes = staged(sizes, "pfair-sources")
    if sizes.count() <= most:
        found = {r.source: r for r in sizes.collect()}
        if weights is None:
            weights = tempered({s: r.bytes for s, r in found.items()}, temperature)
        wanted = {s: weights[s] for s in found if weights.get(s, 0) > 0}
        with_entry = blocks.withColumns({"entry": F.col("source"), "nth_of_entry": F.col("block")})
        return with_entry, {s: r.blocks for s, r in found.items()}, wanted
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.greatest("bytes", F.lit(1)), F.lit(1 / temperature)))
    else:
        given = spark.createDataFrame([(s, float(w)) for s, w in weights.items() if w > 0], "named string, weight double")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    weighed = staged(weighed, "pfair-weights")
    half = most // 2
    largest = weighed.orderBy(F.desc("weight"), F.asc_nulls_first("source")).limit(half).withColumn("large", F.lit(True))
    largest = staged(largest.select(F.col("source").alias("named"), "large"), "pfair-large")
    mark = "\0group "
    while any((r.named or "").startswith(mark) for r in largest.collect()):
        mark = "\0" + mark
    group = F.concat(F.lit(mark), F.pmod(F.xxhash64("source"), F.lit(most - half)).cast("string"))
    members = weighed.join(largest, F.col("source").eqNullSafe(F.col("named")), "left")
    members = members.withColumn("entry", F.when(F.col("large"), F.coalesce("source", F.lit(mark))).otherwise(group))
    members = staged(members.select("source", "entry", "weight", "blocks", F.col("large").isNull().alias("small")), "pfair-entries")
    entries = members.groupBy("entry").agg(F.sum("weight").alias("weight"), F.sum("blocks").alias("blocks")).collect()
    every = members.filter("small").select("source", "entry", "weight", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    inside = Window.partitionBy("entry").orderBy((F.col("block") + 1) / F.col("weight"), "source", "block")
    every = every.select("source", "block", (F.row_number().over(inside) - 1).cast("long").alias("nth"))
    nth = staged(every.select(F.col("source").alias("in_source"), F.col("block").alias("in_block"), "nth"), "pfair-inside")
    of_source = members.select(F.col("source").alias("of"), "entry")
    rows = blocks.join(of_source, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    here = F.col("source").eqNullSafe(F.col("in_source")) & (F.col("block") == F.col("in_block"))
    rows = rows.join(nth, here, "left").withColumn("nth_of_entry", F.coalesce("nth", "block"))
    rows = staged(rows.drop("in_source", "in_block", "nth"), "pfair-grouped")
    return rows, {r.entry: r.blocks for r in entries}, {r.entry: r.weight for r in entries}


def mix_sources(
    docs: DataFrame, weights: dict | None = None, temperature: float = 2.0, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", period: int = PERIOD, most: int = MAX_SOURCES,
) -> DataFrame:
    """Interleave blocks of sources so that any number of first slots holds every source to its target weight.

    Returns per row the id, ``tie`` (a hash of the text), ``source``, ``size``, ``block`` (number in its source), ``slot`` (of its
    block in the mix) and ``in_mix``: the slot lies before the first that a source would leave empty. Up to there
    each source's number of blocks differs from its target by less than one, at every slot. A block is the next
    ``block_bytes`` of a source, and a document goes where it begins; one longer than a block fills the next slots of its source too.

    ``weights`` names the target weight of each source; sources it does not name, or names with 0, have no slot and are
    not in the mix. Without it, weights are the sources' bytes to the power ``1 / temperature``. Weights are
    rounded to whole slots of a period, whose schedule is the only thing made on the driver: ``period`` rows, or ten for each
    entry. An entry is a source; of more than ``most`` sources the smaller ones share entries (see ``_scheduled``), and the law holds
    for their entries. A null source is a source of its own. A null text has size 1. Rows
    with equal ids follow each other by ``tie``; null ids come first. Other columns are not read. An empty table gives an
    empty result.
    """
    blocks, found, wanted = _scheduled(docs, weights, temperature, block_bytes, (id_col, text_col, source_col), most)
    shares = whole_shares(wanted, period) if wanted else {}
    length = sum(shares.values())
    table = staged(period_table(blocks.sparkSession, shares), "pfair-period")
    share_of = table.groupBy("period_source").agg(F.max("share").alias("share")).withColumnRenamed("period_source", "of")
    with_share = blocks.join(share_of, F.col("entry").eqNullSafe(F.col("of")), "left")
    same = (
        F.col("entry").eqNullSafe(F.col("period_source")) & ((F.col("nth_of_entry") % with_share["share"]) == F.col("nth"))
    )
    slotted = with_share.join(table.drop("share"), same, "left")
    slot = F.floor(F.col("nth_of_entry") / F.col("share")) * length + F.col("period_slot")
    # The first block that an entry does not have, in slots: the mix ends before the earliest of them.
    place = {(source, nth): slot for slot, source, nth in schedule(shares)}
    ends = [found[s] // share * length + place[s, found[s] % share] for s, share in shares.items()]
    horizon = F.lit(min(ends, default=0))
    return slotted.select(
        F.col("id").alias(id_col), "tie", "source", "size", "block", slot.cast("long").alias("slot"),
        F.coalesce(slot < horizon, F.lit(False)).alias("in_mix"),
    )


def phases(weights: dict, blocks: dict, period: int = PERIOD) -> Iterator[tuple[list[tuple], list[tuple]]]:
    """The mix of all blocks, phase by phase. A phase ends where an entry has no block left; the others share the next by
    their weights alone, rescaled. Slots follow each other without gaps.

    Of each phase: the entries that have blocks in it (phase, entry, its first block, the first after, share, first slot of
    the phase, length of its period), and the slots of its first period, as far as it goes (phase, entry, block from 0, slot).
    """
    whole = whole_weights(weights)
    done, first, phase = dict.fromkeys(whole, 0), 0, 0
    while live := {s: w for s, w in whole.items() if done[s] < blocks[s]}:
        shares = whole_shares(live, period)
        length = sum(shares.values())
        rest = {s: blocks[s] - done[s] for s in live}
        rounds = min(rest[s] // share for s, share in shares.items())
        # Whoever has no more rounds than that is out at its next block after them.
        last = {s: rest[s] % share for s, share in shares.items() if rest[s] // share == rounds}
        taken, plan, end = dict.fromkeys(shares, 0), [], None
        for slot, (source, nth) in enumerate(slots_in_order(shares)):
            if end is None and last.get(source) == nth:
                end = slot
                if not rounds:
                    break
            if end is None:
                taken[source] += 1
            plan.append((phase, source, nth, slot))
        taken = {s: n + rounds * shares[s] for s, n in taken.items()}
        yield [(phase, s, done[s], done[s] + n, shares[s], first, length) for s, n in taken.items() if n], plan
        done = {s: n + taken.get(s, 0) for s, n in done.items()}
        first, phase = first + rounds * length + end, phase + 1


def _phase_tables(spark: SparkSession, weights: dict, blocks: dict, period: int) -> tuple[DataFrame, DataFrame]:
    """``phases`` as written tables; the driver holds ``ROWS_AT_ONCE`` rows or one phase. Entries are numbered in ``entries``."""
    number = {entry: n for n, entry in enumerate(weights)}
    names = {"spans": "phase in_entry low high share first length".split(), "slots": "in_phase of_entry nth period_slot".split()}
    paths = {kind: scratch_path(spark, f"pfair-{kind}") for kind in names}
    held: dict[str, list] = {kind: [] for kind in names}

    def write(kind):
        columns = np.array(held[kind], np.int64).reshape(-1, len(names[kind])).T
        spark.createDataFrame(pa.table(dict(zip(names[kind], map(pa.array, columns), strict=True)))).write.mode("append").parquet(paths[kind])
        held[kind].clear()

    for spans, slots in phases(weights, blocks, period):
        held["spans"] += [(phase, number[entry], *more) for phase, entry, *more in spans]
        held["slots"] += [(phase, number[entry], *more) for phase, entry, *more in slots]
        for kind, rows in held.items():
            if len(rows) >= ROWS_AT_ONCE:
                write(kind)
    for kind in names:
        write(kind)
    return tuple(spark.read.parquet(paths[kind]) for kind in names)


def mix_to_end(
    docs: DataFrame, weights: dict | None = None, temperature: float = 2.0, block_bytes: int = BLOCK_BYTES,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", period: int = PERIOD, most: int = MAX_SOURCES,
) -> DataFrame:
    """``mix_sources`` carried on to the last block: the id, ``tie``, ``source``, ``size``, ``block`` and ``slot``.

    Up to the first slot that a source would leave empty the slots are those of ``mix_sources``. From there the
    other entries go on at their weights, rescaled among themselves, until the next one is out, and so on to the end (see
    ``phases``); within a phase each entry's number of blocks differs from its target by less than one. Every row whose
    source has a weight has a slot; the others have none. The driver works out at most one period a phase and a phase an
    entry, so what it does is bounded by ``most``, not by the rows.
    """
    rows, found, wanted = _scheduled(docs, weights, temperature, block_bytes, (id_col, text_col, source_col), most)
    spark = rows.sparkSession
    spans, slots = _phase_tables(spark, wanted, found, period)
    # A row per block, from spans cut into pieces that a task can list.
    piece = 1 << 12
    pieces = F.explode(F.sequence(F.col("low"), F.col("high") - 1, F.lit(piece).cast("long"))).alias("start")
    every = spans.select("*", pieces)
    every = every.select("*", F.explode(F.sequence("start", F.least(F.col("start") + piece, F.col("high")) - 1)).alias("at"))
    own = F.col("at") - F.col("low")
    every = every.join(slots, (F.col("phase") == F.col("in_phase")) & (F.col("in_entry") == F.col("of_entry")) & (own % F.col("share") == F.col("nth")))
    slot = F.col("first") + F.floor(own / F.col("share")) * F.col("length") + F.col("period_slot")
    placed = staged(every.select("in_entry", "at", slot.cast("long").alias("slot")), "pfair-slots")
    numbers = spark.createDataFrame([(entry, n) for n, entry in enumerate(wanted)], "named string, number long")
    rows = rows.join(staged(numbers, "pfair-numbers"), F.col("entry").eqNullSafe(F.col("named")), "left")
    rows = rows.join(placed, (F.col("number") == F.col("in_entry")) & (F.col("nth_of_entry") == F.col("at")), "left")
    return rows.select(F.col("id").alias(id_col), "tie", "source", "size", "block", "slot")
