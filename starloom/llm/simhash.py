"""SimHash near-duplicates: exact comparison of tiles of fingerprints, far fewer than all tile pairs."""

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from starloom.llm.common import arrow_schema, ddl, table_parts
from starloom.llm.components import components
from starloom.scratch import staged

SEED = 42
CHUNK = 1 << 15
TILE = 8192
BLOCK = 32


def simhash(text: str, shingle: int) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half the hashes of the shingles.

    A-Z become lower case, words are runs without ASCII white space, shingles are ``shingle`` words joined by
    blanks, each counted as often as it occurs; fewer words are one shingle; without words it is 0.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(0, len(words) - shingle)
    ones = np.zeros(64, np.int64)
    for low in range(0, last + 1, CHUNK):
        high = min(last + 1, low + CHUNK)
        spans = zip(starts[low:high].tolist(), ends[min(shingle, len(words)) - 1 + low :].tolist(), strict=False)
        hashed = map(xxh64_intdigest, [joined[s:e] for s, e in spans], repeat(SEED))
        hashes = np.fromiter(hashed, np.uint64, high - low)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > last + 1, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``tie`` (a hash of the text) and ``print``, the fingerprint as a signed long, of every row; a null text counts
    as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    schema = f"{ddl(rows, id='id', tie='tie')}, print bigint"
    out_schema = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            prints = [simhash(t.as_py(), shingle) for t in batch.column("text")]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), signed], schema=out_schema)

    return rows.mapInArrow(run, schema)


def near_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs within ``radius`` bits, inside ``a`` or between ``a`` and ``b``.

    Every pair is compared; of a large group that is all alike only as many links as it has members come out.
    """
    nodes = a if b is None else np.concatenate([a, b])
    group = np.arange(len(nodes))
    other, shift = (a, 0) if b is None else (b, len(a))
    for low in range(0, len(a), BLOCK):
        near = np.bitwise_count(a[low : low + BLOCK, None] ^ other[None, :]) <= radius
        for i in np.flatnonzero(near.sum(axis=1) > (b is None)):
            here = group[low + i]
            met = group[np.flatnonzero(near[i]) + shift]
            if (met == here).all():
                continue
            for there in np.unique(met[met != here]):
                yield int(nodes[here]), int(nodes[there])
                group[group == there] = here


def near_print_links(prints: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """Links ``a``, ``b`` that join all fingerprints (column ``print``, each once) within ``radius`` bits.

    Fingerprints lie in cells by the population counts of their halves, cells are cut into tiles by hash. Pairs of
    tiles whose counts differ by more than ``radius`` in sum cannot hold a pair and are skipped; all others are
    compared by exclusive or and bit count. A tile pair is one row; a task holds two tiles at a time. A cell of any size
    is cut into tiles of about ``tile`` rows, and gives links enough to join what belongs together, not all pairs.
    """
    low_half = F.col("print").bitwiseAND(0xFFFFFFFF)
    cells = prints.select(
        "print", F.bit_count(low_half).alias("x"), F.bit_count(F.shiftrightunsigned("print", 32)).alias("y")
    )
    sizes = cells.groupBy("x", "y").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("tiles"))
    sizes = staged(sizes, "simhash-cells")  # 33 x 33 at most
    sized = cells.join(sizes, ["x", "y"]).withColumn("tile", F.pmod(F.xxhash64("print", F.lit(1)), "tiles").cast("int"))
    tiles = staged(sized.groupBy("x", "y", "tile").agg(F.collect_list("print").alias("prints")), "simhash-tiles")
    steps = [
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
        for dx in range(radius + 1)
        for dy in range(-radius, radius + 1)
        if dx + abs(dy) <= radius and (dx, dy) >= (0, 0)
    ]
    left = tiles.select("x", "y", "tile", F.col("prints").alias("left"), F.explode(F.array(*steps)).alias("step"))
    left = left.select(
        (F.col("x") + F.col("step.dx")).alias("x"), (F.col("y") + F.col("step.dy")).alias("y"), "left",
        F.col("tile").alias("left_tile"), ((F.col("step.dx") == 0) & (F.col("step.dy") == 0)).alias("same_cell"),
    )
    first = F.when(F.col("same_cell"), F.col("left_tile")).otherwise(0)
    partners = F.explode(F.sequence(first, F.col("tiles") - 1)).alias("tile")
    left = left.join(sizes, ["x", "y"]).select("x", "y", partners, "left", "left_tile", "same_cell")
    parts = table_parts(prints)
    keys = ["x", "y", "tile"]
    pairs = left.repartition(parts, *keys).join(tiles.repartition(parts, *keys), keys)
    itself = (F.col("same_cell") & (F.col("left_tile") == F.col("tile"))).alias("itself")
    schema = "a bigint, b bigint"
    out_schema = arrow_schema(schema)

    def compare(batches):
        for batch in batches:
            for left, right, itself in zip(*(batch.column(c) for c in ("left", "prints", "itself")), strict=True):
                own = left.values.to_numpy().view(np.uint64)
                other = None if itself.as_py() else right.values.to_numpy().view(np.uint64)
                if links := list(near_links(own, other, radius)):
                    ends = np.array(links, np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=out_schema)

    return pairs.select("left", "prints", itself).mapInArrow(compare, schema)


def simhash_groups(
    docs: DataFrame, shingle: int, radius: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row the id, ``tie`` (a hash of the text), ``print``, ``group`` (a fingerprint that names the component) and
    ``component_id``: the smallest id reachable over links of ``radius`` bits or less.

    Texts stay where they lie; only ids and fingerprints are shuffled. Equal fingerprints are one node, so exact
    copies cost nothing further. A null text counts as empty; its fingerprint, 0, links like any other. A null id
    is never the smallest unless its group has no other. Rows with equal ids are rows of their own. Other columns are not
    read. An empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    nodes = staged(prints.groupBy("print").agg(F.min("id").alias("first")), "simhash-nodes")
    links = staged(near_print_links(nodes.select("print"), radius), "simhash-links")
    found = components(links, "simhash-components")
    linked = staged(nodes.join(found, F.col("print") == F.col("node")).select("print", "first", "root"), "simhash-linked")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of")
    in_groups = linked.join(smallest, F.col("root") == F.col("of")).select("print", "root", "component_id")
    alone = nodes.join(linked.select("print"), "print", "left_anti").select(
        "print", F.col("print").alias("root"), F.col("first").alias("component_id")
    )
    # Written, so that the hot fingerprints of ``prints`` meet them in a join that adaptive execution can split.
    groups = staged(in_groups.unionAll(alone).withColumnRenamed("print", "p"), "simhash-groups")
    return prints.join(groups, F.col("print") == F.col("p")).select(
        F.col("id").alias(id_col), "tie", "print", F.col("root").alias("group"), "component_id"
    )
