"""Sharding by fixed virtual slots and a stored, versioned map from slots to shards. DataFrame operations only."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import running_before
from starloom.scratch import staged

SLOTS = 4096
CELL_ROWS = 1 << 18
PART_OF_SHARD = 8  # rows of one id that are more than this part of an even shard are spread one by one


def with_slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per row the id, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``spread`` and ``virtual_slot``.

    The slot comes from a hash of the id alone, so it does not move when a text is edited; rows without an id
    are spread by their texts. A null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\0"), text)))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), own.alias("spread"),
    ).withColumn("virtual_slot", F.pmod("spread", F.lit(slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    """``virtual_slot`` and its ``bytes``: one row per slot that is used, whatever the number of rows."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))


def edited_map(
    sizes: DataFrame, shards: int, old: DataFrame | None = None, slots: int = SLOTS, slack: float = 0.02
) -> DataFrame:
    """The next version of the map: ``version``, ``virtual_slot``, ``shard`` and ``bytes`` for all ``slots``.

    Slots go by size, the largest first. One without a shard so far, or whose shard is gone, goes to the lightest
    shard. One that has a shard stays, unless its shard holds more than an equal part, would hold no less than
    that (``slack`` under it without new shards) without the slot, and there is one that would still hold no more than it with the
    slot: with new shards the lightest of them, so that rows move into new shards only; else the lightest of all, and only
    out of shards that are over by more than ``slack``. All that is looked at is one row per slot, a fixed number.
    """
    every = sizes.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    every = every.join(sizes, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    if old is None:
        every = every.withColumn("was", F.lit(None).cast("int"))
        version, old_shards = F.lit(0), shards
    else:
        every = every.join(old.select("virtual_slot", F.col("shard").alias("was")), "virtual_slot", "left")
        every = every.withColumn("was", F.when(F.col("was") < shards, F.col("was")))
        last, highest = old.agg(F.max("version"), F.max("shard")).first()
        version, old_shards = F.lit(last + 1), highest + 1
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "was")))
    one = every.agg(ordered.alias("slots"), F.ceil(F.sum("bytes") / shards).alias("even"))
    shard_ids = F.sequence(F.lit(0), F.lit(shards - 1))
    held = F.transform(
        shard_ids,
        lambda s: F.aggregate(
            "slots", F.lit(0).cast("long"), lambda n, x: n - F.when(x["was"] == s, x["minus"]).otherwise(0)
        ),
    )

    grown = old_shards < shards
    first = old_shards if grown else 0
    # Shards that give to new ones stop at an equal part, so that all of them give and none gives more than it has over.
    most, least_left = F.col("even") * (1 if grown else 1 + slack), F.col("even") * (1 if grown else 1 - slack)

    def place(state, slot):
        size, was = -slot["minus"], slot["was"]
        least = F.array_min(F.slice(state["load"], first + 1, shards - first))
        there = F.array_position(F.slice(state["load"], first + 1, shards - first), least) - 1 + first
        lightest = F.array_position(state["load"], F.array_min(state["load"])) - 1
        own = F.element_at(state["load"], was + 1)
        moves = (size > 0) & (own > most) & (own - size >= least_left) & (least + size <= F.col("even"))
        to = F.when(was.isNull(), lightest).when(moves, there).otherwise(was).cast("int")
        load = F.transform(
            state["load"],
            lambda n, s: n + F.when(s == to, size).otherwise(0) - F.when(s == was, size).otherwise(0),
        )
        return F.struct(load.alias("load"), F.concat(state["to"], F.array(to)).alias("to"))

    start = F.struct(held.alias("load"), F.array().cast("array<int>").alias("to"))
    placed = one.select("slots", F.aggregate("slots", start, place)["to"].alias("to"))
    pairs = placed.select(F.explode(F.arrays_zip("slots", "to")).alias("s"))
    return pairs.select(
        version.cast("int").alias("version"), F.col("s.slots.virtual_slot").alias("virtual_slot"),
        F.col("s.to").alias("shard"), (-F.col("s.slots.minus")).alias("bytes"),
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the maps at ``path``; earlier versions stay readable."""
    slot_map.coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map at ``path``, the latest if none is named."""
    maps = spark.read.parquet(path)
    wanted = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.filter(F.col("version") == wanted)


def latest_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version at ``path``, None if nothing is stored there."""
    try:
        return read_map(spark, path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def placed_rows(rows: DataFrame, slot_map: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, their place in it from 0, without gaps, by virtual slot and hash.

    Rows are counted per cell, a range of hashes in a virtual slot small enough for a task, cells are summed
    up per shard, and rows are numbered in their cell. The order does not depend on the number of cells.
    """
    per_slot = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    cells_of = per_slot.select(F.col("virtual_slot").alias("v"), F.ceil(F.col("n") / CELL_ROWS).cast("long").alias("cells"))
    mapped = staged(
        slot_map.join(cells_of, F.col("virtual_slot") == F.col("v")).select("v", "shard", "cells"), "slot-shards"
    )
    # The hash without the part that chose the slot, as a fraction of its range.
    top = F.shiftrightunsigned(F.col("spread"), 33)
    cell = F.floor(top * F.col("cells") / F.lit(1 << 31)).cast("long")
    rows = rows.join(mapped, F.col("virtual_slot") == F.col("v")).withColumn("cell", cell)
    counts = staged(rows.groupBy("shard", "v", "cell").agg(F.count(F.lit(1)).alias("n")), "slot-cells")
    before = running_before(counts, "n", "before", ["v", "cell"], ["shard"])
    before = before.select(F.col("v").alias("at_slot"), F.col("cell").alias("at_cell"), "before")
    in_cell = Window.partitionBy("v", "cell").orderBy(top, "spread", "id", "size", "text_crc32")
    numbered = rows.withColumn("nth", F.row_number().over(in_cell))
    same_cell = (F.col("v") == F.col("at_slot")) & (F.col("cell") == F.col("at_cell"))
    return numbered.join(before, same_cell).withColumn("slot", F.col("before") + F.col("nth") - 1)


def with_hot_ids_spread(rows: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """``rows`` (written, with a number ``row``) with those of an id that is too heavy for one slot spread over all slots.

    Such ids lie in the few slots that are too heavy, so only these are summed by id; there are at most as many as
    parts of ``PART_OF_SHARD`` in all shards.
    """
    sizes = staged(slot_bytes(rows), "slot-bytes")
    most = (sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // (PART_OF_SHARD * shards)
    heavy = sizes.filter(F.col("bytes") > most).select("virtual_slot")
    by_id = rows.join(heavy, "virtual_slot", "left_semi").groupBy("spread")
    by_id = by_id.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    hot = staged(by_id.filter((F.col("bytes") > most) & (F.col("n") > 1)).select(F.col("spread").alias("hot")), "slot-hot")
    if hot.isEmpty():
        return rows
    spread = F.when(F.col("hot").isNull(), F.col("spread")).otherwise(F.xxhash64("spread", "row"))
    rows = rows.join(hot, F.col("spread") == F.col("hot"), "left").withColumn("spread", spread).drop("hot")
    return staged(rows.withColumn("virtual_slot", F.pmod("spread", F.lit(slots)).cast("int")), "slot-rows")


def update_map(sizes: DataFrame, shards: int, map_path: str, slots: int = SLOTS) -> DataFrame:
    """The map at ``map_path`` for these bytes per slot and number of shards: a first one, or an edited one, which becomes a new
    version only if a slot changes its shard."""
    spark = sizes.sparkSession
    old = latest_map(spark, map_path)
    if old is not None and (n := old.count()) != slots:
        raise ValueError(f"the map at {map_path} has {n} slots, not {slots}")
    edited = staged(edited_map(sizes, shards, old, slots), "slot-map-edited")
    was = None if old is None else old.select("virtual_slot", F.col("shard").alias("was"))
    if was is None or not edited.join(was, "virtual_slot").filter(F.col("shard") != F.col("was")).isEmpty():
        store_map(edited, map_path)
    return read_map(spark, map_path)


def virtual_shards(
    docs: DataFrame, shards: int, map_path: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS
) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes, by the latest map at ``map_path``.

    Without a map there, a first one is made from the bytes of the slots and stored. A map that is there is edited
    (see ``edited_map``) for the bytes and the number of shards; a new version is stored only if a slot changes its shard.
    One row per row of ``docs``: the id, ``size``, ``text_crc32`` (of the UTF-8 bytes, unsigned), ``shard``, ``slot`` (its
    place in the shard, from 0, without gaps), ``virtual_slot`` and ``map_version``. Texts are read where they lie;
    only sizes and hashes are shuffled.

    A null text counts as empty. Null ids are spread by text; rows with equal ids share a virtual slot, unless together they
    are too heavy for one: then they are spread one by one (see ``with_hot_ids_spread``). Other columns are not read. An empty table gives an empty result and a map that deals the slots out in turn.
    """
    rows = with_slots(docs, id_col, text_col, slots).withColumn("row", F.monotonically_increasing_id())
    rows = with_hot_ids_spread(staged(rows, "slot-rows"), shards, slots)
    slot_map = update_map(slot_bytes(rows), shards, map_path, slots)
    version = slot_map.agg(F.max("version")).first()[0]
    return placed_rows(rows, slot_map, slots).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", "virtual_slot",
        F.lit(version).alias("map_version"),
    )
