"""Document fingerprints from closed syncmers.

A window of ``k`` code points is an anchor if the smallest hash of its inner windows of ``s`` code points lies at its
first or last place. That depends on the ``k`` code points alone, so an unchanged passage keeps its anchors
wherever it stands, and two anchors are at most ``k - s`` code points apart. A fingerprint keeps every anchor
whose hash lies in the lowest 32nd of all hashes, and at least the ``m`` of smallest hash, each with its place; so it is
as dense in a long text as in a short one. Two are compared by the anchors they share in the same order.
"""

import base64
import bisect
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from starloom.llm.common import arrow_schema, batches_of, ddl, table_parts

K, S, M = 16, 9, 64
KEPT_BELOW = 1 << 27  # of 32-bit hashes: one anchor in 32, some 128 code points apart
KEY = ("nameless", "down", "tie")  # the order of documents: ids fall, null ids come last, then the hash of the text
CHUNK = 1 << 16
ANCHOR = np.dtype([("hash", "<u4"), ("place", "<u4")])
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _window_hashes(points: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Polynomial hashes of all windows of each size, by doubling; ascending sizes."""
    out, size = {}, 1
    powers_of_two = {1: (points, np.array([BASE]))}
    while 2 * size <= max(sizes):
        hashes, power = powers_of_two[size]
        powers_of_two[2 * size] = (hashes[:-size] * power + hashes[size:], power * power)
        size *= 2
    for wanted in sizes:
        total, width = None, 0
        for step in (1 << b for b in range(wanted.bit_length() - 1, -1, -1) if wanted >> b & 1):
            hashes, power = powers_of_two[step]
            if total is None:
                total = hashes
            else:
                total = total[: len(hashes) - width] * power + hashes[width:]
            width += step
        out[wanted] = total[: len(points) - wanted + 1]
    return [out[w] for w in sizes]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and places of all closed syncmers. A text of fewer than ``k`` points is one anchor."""
    if len(points) < k:
        digest = hashlib.blake2b(points.tobytes(), digest_size=4).digest()
        return np.frombuffer(digest, "<u4")[: len(points)], np.zeros(min(1, len(points)), np.int64)
    hashes, places = [], []
    for low in range(0, len(points) - k + 1, CHUNK):
        inner, outer = _window_hashes(points[low : low + CHUNK + k - 1].astype(np.uint64) + np.uint64(1), s, k)
        inner = _mixed(inner)
        least, width = inner, 1
        while width < k - s + 1:
            step = min(width, k - s + 1 - width)
            least, width = np.minimum(least[: len(least) - step], least[step:]), width + step
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
        hashes.append((_mixed(outer[at]) >> np.uint64(32)).astype(np.uint32))
        places.append(at + low)
    return np.concatenate(hashes), np.concatenate(places)


def fingerprint(points: np.ndarray, m: int = M) -> np.ndarray:
    """Anchors with a hash under ``KEPT_BELOW``, or the ``m`` of smallest hash if those are more; by hash, of equal ones the first."""
    hashes, places = anchors(points)
    hashes, first = np.unique(hashes, return_index=True)
    kept = min(len(hashes), max(m, int(np.searchsorted(hashes, KEPT_BELOW))))
    out = np.empty(kept, ANCHOR)
    out["hash"], out["place"] = hashes[:kept], np.minimum(places[first[:kept]], 0xFFFFFFFF)
    return out


def as_text(print_: np.ndarray) -> str:
    return base64.b64encode(print_.tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ANCHOR)


def likeness(a: np.ndarray, b: np.ndarray, m: int = M) -> float:
    """Of the hashes of both under ``KEPT_BELOW``, at least the ``m`` smallest, the part that both have in the same order.

    Equal texts give 1, as do two without anchors. Anchors that are shared by chance stand in another order as a rule
    and do not count. Either fingerprint holds all its text's anchors up to that limit, so nothing is compared with a gap.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a["hash"], b["hash"])
    union = union[: max(m, int(np.searchsorted(union, KEPT_BELOW)))]
    _, of_a, of_b = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    shared = a["hash"][of_a] <= union[-1]
    places = b["place"][of_b[shared]][np.argsort(a["place"][of_a[shared]], kind="stable")]
    tails: list[int] = []  # the longest ascending run: the smallest last place for each length
    for place in places.tolist():
        at = bisect.bisect_left(tails, place)
        tails[at : at + 1] = [place]
    return len(tails) / len(union)


def _heads(rows: DataFrame, parts: int) -> list[Row]:
    """The first key of each of up to ``parts`` ranges of about equally many rows."""
    ranges = rows.select(*KEY).repartitionByRange(parts, *KEY).withColumn("range", F.spark_partition_id())
    heads = ranges.groupBy("range").agg(F.min(F.struct(*KEY)).alias("head")).collect()
    return [r.head for r in sorted(heads, key=lambda r: r.range)]


def _goes(heads: list[Row]) -> Column:
    """The range of a row; for the first of a range also the one before, the last range for the very first row."""
    types = dict(zip(KEY, ("boolean", "long", "long"), strict=True))
    heads = heads or [Row(**{k: None for k in KEY})]
    array = F.array(*[F.struct(*[F.lit(h[k]).cast(t).alias(k) for k, t in types.items()]) for h in heads])
    key = F.struct(*KEY)
    steps = F.array(*[F.lit(1 << i) for i in range(len(heads).bit_length() - 1, -1, -1)])
    up_to = F.aggregate(  # a binary search: how many heads are not above the key
        steps,
        F.lit(0),
        lambda n, step: n
        + F.when((n + step <= len(heads)) & (F.try_element_at(array, n + step) <= key), step).otherwise(0),
    )
    before = F.when(up_to > 1, up_to - 2).otherwise(len(heads) - 1)
    return F.when(F.element_at(array, up_to) == key, F.array(up_to - 1, before)).otherwise(F.array(up_to - 1))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with how like the text's is to two others.

    The next document is the one with the next smaller id, after the last the first. The edited text is the text
    with its last ``n_chars // 2`` code points replaced by as many of the next document's first, or all it has. Returns the id,
    ``n_chars``, ``edited_sha256`` (lower-case hex of the UTF-8 bytes), ``fingerprint``, ``edited_fingerprint`` and the
    likenesses ``near_edited`` and ``near_next``, from 0 to 1.

    Texts move once, into ranges of descending ids; the first document of each range also goes to the range before,
    whose last document it follows. A task reads its range in order and holds two documents at a time. Ranges are cut by
    id and a hash of the text, so rows of one id, or without any, are spread over as many as they fill.

    Ids are integers. A null text counts as empty. Null ids come last; rows with equal ids follow
    each other by the hash of their texts, and only rows equal in both are kept together. A single document is its own next. Other columns are not read. An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    down = F.bitwise_not(F.col("id").cast("long"))
    rows = rows.select("*", F.col("id").isNull().alias("nameless"), down.alias("down"), F.xxhash64("text").alias("tie"))
    heads = _heads(rows, max(2, table_parts(docs) - 1))
    placed = rows.select("id", "text", *KEY, F.posexplode(_goes(heads)).alias("next", "to_part"))
    ranges = placed.repartitionById(max(1, len(heads)), "to_part")
    ranges = ranges.sortWithinPartitions("next", *KEY).select("id", "text", "next")
    fields = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string"
    schema = f"{ddl(rows, id='id')}, {fields}, near_edited double, near_next double"
    out_schema = arrow_schema(schema)

    def run(batches):
        def compared(own, text, points, print_, next_text, next_print):
            half = len(points) // 2
            edited = text[: len(points) - half] + next_text[:half]
            edited_print = fingerprint(code_points(edited))
            digest = hashlib.sha256(edited.encode()).hexdigest()
            return (
                own, len(points), digest, as_text(print_), as_text(edited_print),
                likeness(print_, edited_print), likeness(print_, next_print),
            )

        def rows_out():
            held = None
            for batch in batches:
                for own, text, is_next in zip(*(batch.column(c) for c in ("id", "text", "next")), strict=True):
                    text = text.as_py()
                    if held is not None and text == held[1]:
                        points, print_ = held[2:]
                    else:
                        points = code_points(text)
                        print_ = fingerprint(points)
                    if held is not None:
                        yield compared(*held, text, print_)
                    if is_next.as_py():
                        return
                    held = own.as_py(), text, points, print_

        yield from batches_of(rows_out(), out_schema, 512)

    return ranges.mapInArrow(run, schema).withColumnRenamed("id", id_col)
