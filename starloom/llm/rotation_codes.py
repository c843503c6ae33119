"""Embedding near-duplicates by randomised-rotation binary codes with stored correction factors.

A unit vector ``o`` is rotated and stored as its signs, one bit a component, with the factor ``f = <o, s>``, where ``s``
is the unit vector of the signs. For another unit vector ``q``:

* ``<s, q> / f`` is an unbiased estimate of ``<o, q>`` over the random rotation; its error is at most
  ``epsilon * sqrt(1 - f * f) / f / sqrt(d - 1)`` but for a probability that falls as ``exp(-epsilon ** 2 / 2)``;
* ``<o, q> <= f * c + sqrt(1 - f * f) * sqrt(1 - c * c)`` with ``c = <s, q>``, always.

A pair is recomputed in double precision unless the upper confidence bound or the second bound, which
cannot fail, lies below the threshold. So every link found is exact.
"""

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from starloom.llm.common import arrow_schema, table_parts
from starloom.llm.components import components
from starloom.scratch import staged

EPSILON = 6.0
TILE = 1024
EXACT_AT_ONCE = 1 << 15
ROUNDING = 1e-4  # of the single-precision products, on the safe side


@functools.lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """The same random rotation for every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 without overflow or underflow on the way."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the rotated unit vectors, and their correction factors."""
    rotated = unit(vectors) @ rotation(vectors.shape[1])
    return np.packbits(rotated > 0, axis=1, bitorder="little"), np.abs(rotated).sum(axis=1) / np.sqrt(vectors.shape[1])


def estimate(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the cosines (codes by queries) and the products ``<s, q>`` they come from."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim, bitorder="little").astype(np.float32) * 2 - 1
    rotated = (unit(queries) @ rotation(dim)).astype(np.float32)
    products = signs @ rotated.T / np.float32(np.sqrt(dim))
    return products / factors[:, None].astype(np.float32), products


def least_products(factors: np.ndarray, dim: int, threshold: float, epsilon: float = EPSILON) -> np.ndarray:
    """Per code: pairs with a smaller product ``<s, q>`` are below the threshold, by either bound."""
    f = np.clip(factors, 1e-9, 1.0)
    certain = np.cos(np.minimum(np.pi, np.arccos(f) + np.arccos(threshold)))
    likely = f * threshold - epsilon * np.sqrt(1 - f * f) / np.sqrt(max(dim - 1, 1))
    return np.maximum(certain, likely) - ROUNDING


def linked(a: np.ndarray, codes: np.ndarray, factors: np.ndarray, b: np.ndarray | None, threshold: float):
    """Index pairs (i of ``a``, j of ``b``, or both of ``a`` and i < j) whose cosine reaches the threshold."""
    other = a if b is None else b
    _, products = estimate(codes, factors, other)
    near = products >= least_products(factors, a.shape[1], threshold)[:, None]
    rows, columns = np.nonzero(np.triu(near, 1) if b is None else near)
    ua, ub = unit(a), unit(other)
    for low in range(0, len(rows), EXACT_AT_ONCE):
        i, j = rows[low : low + EXACT_AT_ONCE], columns[low : low + EXACT_AT_ONCE]
        cosine = np.einsum("ij,ij->i", ua[i], ub[j])
        yield i[cosine >= threshold], j[cosine >= threshold]


def tile_links(left, codes, factors, right, threshold: float) -> Iterator[tuple[int, int | None, int | None]]:
    """For two tiles of (uids, copies, vectors), or one with itself (right is None): rows (uid, None, linked
    rows of other vectors) and rows (uid, uid, None) that join all that is linked, no more than there are vectors."""
    uids, copies, vectors = left
    other_uids, other_copies, others = right or left
    counts, other_counts = np.zeros(len(uids), np.int64), np.zeros(len(other_uids), np.int64)
    shift = len(uids) if right else 0
    nodes = np.concatenate([uids, other_uids]) if right else uids
    group = np.arange(len(nodes))
    for i, j in linked(vectors, codes, factors, others if right else None, threshold):
        if not len(i):  # candidates, but no link among them
            continue
        np.add.at(counts, i, other_copies[j])
        np.add.at(other_counts if right else counts, j, copies[i])
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for node, met in zip(i[starts], np.split(j + shift, starts[1:]), strict=True):
            here = group[node]
            for there in np.unique(group[met]):
                if there != here:
                    yield int(nodes[here]), int(nodes[there]), None
                    group[group == there] = here
    for own, n in ((uids, counts), (other_uids, other_counts if right else counts * 0)):
        for at in np.flatnonzero(n):
            yield int(own[at]), None, int(n[at])


def valid_vector(vector, label):
    """Not null, of one component or more, all finite, not all zero, and with a label."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _read_tile(batch: pa.RecordBatch, column: str, row: int):
    rows = batch.column(column)[row].values
    uids, copies, vectors = (rows.field(c) for c in ("uid", "copies", "vector"))
    flat = vectors.flatten().to_numpy().astype(np.float64)
    return uids.to_numpy(), copies.to_numpy(), flat.reshape(len(uids), -1)


def _coded(uniques: DataFrame) -> DataFrame:
    """``uniques`` with ``code`` and ``factor``: each vector is rotated and coded once."""
    schema = StructType([*uniques.schema, StructField("code", BinaryType()), StructField("factor", DoubleType())])
    out_schema = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            codes: list = [b""] * batch.num_rows
            factors = np.zeros(batch.num_rows)
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vectors = batch.column("vector").take(pa.array(at)).flatten().to_numpy().astype(np.float64)
                own, factors[at] = encode(vectors.reshape(len(at), -1))
                for i, code in zip(at, own, strict=True):
                    codes[i] = code.tobytes()
            columns = [*batch.columns, pa.array(codes, pa.binary()), pa.array(factors)]
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return uniques.mapInArrow(run, schema)


def embedding_links(uniques: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """What ``tile_links`` gives, for all pairs of vectors of a ``label`` and ``dim``: columns ``u``, ``v``, ``links``.

    A label's vectors are cut by hash into tiles of about ``tile``; each pair of tiles is a row of its own, so
    that a label with a third of all rows is as many rows as its size asks for. Codes decide which pairs
    of a tile pair are computed in full; what leaves a tile pair is bounded by its vectors.
    """
    sizes = uniques.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("n"))
    sizes = staged(sizes.withColumnsRenamed({"label": "l", "dim": "d"}), "rotation-labels")
    sized = uniques.join(sizes, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")))
    sized = sized.withColumn("tile", F.pmod(F.xxhash64("vector", F.lit(1)), "n").cast("int"))
    member = F.struct("uid", "copies", "vector", "code", "factor")
    tiles = staged(
        sized.groupBy("label", "dim", "n", "tile").agg(F.collect_list(member).alias("members")), "rotation-tiles"
    )
    # Tile t meets t, t + 1, ... around the circle, up to halfway: every pair once, as many for each tile.
    steps = F.floor(F.col("n") / 2).cast("int")
    left = tiles.select("label", "dim", "n", "tile", F.col("members").alias("left"), F.explode(F.sequence(F.lit(0), steps)).alias("step"))
    left = left.filter((F.col("step") * 2 != F.col("n")) | (F.col("tile") < F.col("step")))
    itself = (F.col("step") == 0).alias("itself")
    left = left.select("label", "dim", F.pmod(F.col("tile") + F.col("step"), "n").alias("tile"), "left", itself)
    parts, keys = table_parts(uniques), ["label", "dim", "tile"]
    right = tiles.select(*keys, F.col("members").alias("right"))
    pairs = left.repartition(parts, *keys).join(right.repartition(parts, *keys), keys)
    schema = "u bigint, v bigint, links bigint"
    out_schema = arrow_schema(schema)

    def compare(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                own = _read_tile(batch, "left", row)
                rows = batch.column("left")[row].values
                codes = np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint8).reshape(len(rows), -1)
                right = None if batch.column("itself")[row].as_py() else _read_tile(batch, "right", row)
                out += tile_links(own, codes, rows.field("factor").to_numpy(), right, threshold)
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out_schema)

    return pairs.select("left", "right", "itself").mapInArrow(compare, schema)


def embedding_groups(
    vectors: DataFrame, threshold: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Per row the id, ``n_links`` (other rows of its label with a cosine of ``threshold`` or more), ``component_id``
    (the smallest id reachable over links) and ``kept`` (the id is that one).

    Equal vectors of a label are compared once and counted as often as they occur. Vectors of different lengths
    do not link. Vectors that are null, empty, all zero or hold a null or non-finite component, and those without
    a label, link with nothing: 0 links, a component of their own, kept. A row with a null id counts as a
    link but is never the smallest; alone it has a null component and is not kept. Rows with equal ids are rows
    of their own. Other columns are not read. An empty table gives an empty result.

    Pairs of codes in a label are all looked at, so work grows with the square of a label's distinct vectors,
    in tiles; memory does not.
    """
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"),
        valid_vector(F.col(vector_col), F.col(label_col)).alias("valid"),
    )
    good = rows.filter("valid").drop("valid")
    uniques = good.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
    uniques = uniques.withColumn("dim", F.size("vector")).withColumn("uid", F.monotonically_increasing_id())
    uniques = staged(uniques, "rotation-vectors")
    coded = staged(_coded(uniques.select("uid", "copies", "label", "dim", "vector")), "rotation-codes")
    links = staged(embedding_links(coded, threshold), "rotation-links")
    found = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")), "rotation-components")
    counts = links.filter("links IS NOT NULL").groupBy("u").agg(F.sum("links").alias("others"))
    linked_ones = uniques.join(found, F.col("uid") == F.col("node"), "left").join(counts, F.col("uid") == F.col("u"), "left")
    linked_ones = staged(
        linked_ones.select(
            "label", "vector", "first", F.coalesce("root", "uid").alias("root"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "rotation-linked",
    )
    smallest = linked_ones.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "of")
    groups = linked_ones.join(smallest, F.col("root") == F.col("of")).select(
        F.col("label").alias("l"), F.col("vector").alias("v"), "n_links", "component_id"
    )
    groups = staged(groups, "rotation-groups")
    same = (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    joined = good.join(groups, same).select("id", "n_links", "component_id", kept)
    alone = rows.filter(~F.col("valid")).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept")
    )
    return joined.unionAll(alone).withColumnRenamed("id", id_col)
