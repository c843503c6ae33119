"""Harmonic packing of token sequences: pieces of reciprocal-capacity lengths, a fixed number of them per bin."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import arrow_batches, arrow_schema, ddl, release_memory, running_before
from starloom.llm.tokens import encoder
from starloom.scratch import staged

CAPACITY = 4096
TEXT_AT_ONCE = 2 << 20  # bytes; a worker stays small beside an executor whose heap earlier stages have filled


def cuts(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """The classes of a document's pieces, in order. A piece of class ``i`` is ``capacity // i`` tokens long.

    Each piece is the longest class length that is left; the rest shrinks about quadratically, so a
    document has a few pieces besides its full sequences.
    """
    classes = [1] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        classes.append(capacity // (rest + 1) + 1)
        rest -= capacity // classes[-1]
    return classes


def last_ends(total: int, capacity: int = CAPACITY) -> list[int]:
    """Where the sequences of a stream of ``total`` tokens end after its full ones: at powers of two, unpadded."""
    at, rest, ends = total - total % capacity, total % capacity, []
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def harmonic_packing(
    docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, with_ids: bool = False,
) -> DataFrame:
    """Pack the token ids of every text, each followed by ``end_id``, into sequences of at most ``capacity`` tokens.

    One row per piece: the id, ``start`` (its document's ids before it), ``length``, ``ids_crc32`` (of its ids
    as little-endian unsigned 32-bit integers), ``doc_tokens``, ``sequence_id`` (from 0, without gaps), ``offset``
    (its place there) and, on demand, ``ids`` (those bytes). Every id of every document is in one piece.

    * Documents are cut into pieces of the exact class lengths ``capacity // i``.
    * Every task fills bins of class ``i`` with ``i`` pieces each, without knowing of the others. Bins are
      numbered from the counts per task and class; no piece moves.
    * What a task has left, fewer than ``i`` pieces of a class, keeps its ids. These pieces are numbered
      across tasks in the same way and fill further bins.
    * What is left then, at most ``capacity`` tokens of a class whatever the input, forms one stream cut at ``capacity``;
      its end is cut at powers of two. So padding is at most ``capacity % i`` tokens for a bin of ``i`` pieces.

    A null text counts as empty: one piece with the end id. Ids may be null or repeat; each row is packed by
    itself. Other columns are not read. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    fields = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    schema = f"{ddl(rows, id='id')}, {fields}, task int, class int, bin bigint, nth bigint, ids binary"
    out_schema = arrow_schema(schema)
    lengths_of = {}

    def cut(batches):
        task, encode = TaskContext.get().partitionId(), encoder(vocabulary)
        open_bins: dict[int, list] = {}
        bins: dict[int, int] = {}

        def emitted(pieces):
            columns = zip(*pieces, strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, schema=out_schema)

        end, out = np.array([end_id], np.uint32), []
        for batch in batches:
            for own_id, own in zip(batch.column("id").to_pylist(), encode.ids(batch.column("text"), TEXT_AT_ONCE), strict=True):
                data = memoryview(np.concatenate([own, end]).astype("<u4")).cast("B")
                total, start = len(own) + 1, 0
                for kind in lengths_of.get(total) or lengths_of.setdefault(total, cuts(total, capacity)):
                    length = capacity // kind
                    ids = data[4 * start : 4 * (start + length)]
                    waiting = open_bins.setdefault(kind, [])
                    waiting.append((own_id, start, length, zlib.crc32(ids), total, task, kind, bytes(ids)))
                    start += length
                    if len(waiting) == kind:
                        number = bins.get(kind, 0)
                        out += [(*p[:7], number, n, p[7] if with_ids else None) for n, p in enumerate(waiting)]
                        bins[kind] = number + 1
                        waiting.clear()
                if len(out) >= 4096:
                    yield emitted(out)
                    out = []
            release_memory()
        out += [(*p[:7], None, n, p[7]) for waiting in open_bins.values() for n, p in enumerate(waiting)]
        if out:
            yield emitted(out)

    with arrow_batches(docs.sparkSession, TEXT_AT_ONCE):
        pieces = staged(rows.mapInArrow(cut, schema), "harmonic-pieces")
    numbers = staged(_numbered_bins(pieces), "harmonic-bins")
    left_total = numbers.agg(F.sum("last_tokens"), F.sum("first_bins"), F.sum("second_bins")).first()
    return _placed(pieces, numbers, tuple(int(n or 0) for n in left_total), capacity, with_ids, id_col)


def _numbered_bins(pieces: DataFrame) -> DataFrame:
    """A row per task and class: the number of its first bin, the number of its first left piece among all of the
    class, and what the class has in all. Sums over tasks run within a class, over classes in one row each."""
    counts = pieces.groupBy("class", "task").agg(
        F.coalesce(F.max("bin") + 1, F.lit(0)).cast("long").alias("bins"),
        F.count(F.when(F.col("bin").isNull(), 1)).alias("left"),
        F.max("length").alias("piece"),
    )
    counts = staged(counts, "harmonic-counts")
    classes = counts.groupBy("class").agg(
        F.sum("bins").alias("first_bins"), F.sum("left").alias("all_left"), F.max("piece").alias("piece")
    )
    classes = classes.withColumn("second_bins", F.floor(F.col("all_left") / F.col("class")))
    classes = classes.withColumn(
        "last_tokens", (F.col("all_left") - F.col("second_bins") * F.col("class")) * F.col("piece")
    )
    for total, before in (
        ("first_bins", "first_before"), ("second_bins", "second_before"), ("last_tokens", "last_before"),
    ):
        classes = running_before(classes, total, before, ["class"])
    by_task = running_before(counts, "bins", "bins_before", ["task"], ["class"])
    by_task = running_before(by_task, "left", "left_before", ["task"], ["class"])
    first_of_class = F.min("task").over(Window.partitionBy("class"))
    totals = ["first_bins", "second_bins", "last_tokens"]  # on one row of each class, so that they can be summed
    joined = by_task.drop("piece").join(classes, "class").withColumn("is_first", F.col("task") == first_of_class)
    return joined.withColumn("class_second", F.col("second_bins")).withColumns(
        {c: F.when(F.col("is_first"), F.col(c)).otherwise(0) for c in totals}
    )


def _placed(
    pieces: DataFrame, numbers: DataFrame, totals: tuple[int, int, int], capacity: int, with_ids: bool,
    id_col: str,
) -> DataFrame:
    last_tokens, first_bins, second_bins = totals
    kept = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    numbers = numbers.select(
        F.col("class").alias("c"), F.col("task").alias("t"), "bins_before", "left_before", "first_before",
        "second_before", "last_before", "class_second",
    )
    joined = pieces.join(numbers, (F.col("class") == F.col("c")) & (F.col("task") == F.col("t")))
    ids = F.col("ids") if with_ids else F.lit(None).cast("binary").alias("ids")
    first = joined.filter(F.col("bin").isNotNull()).select(
        *kept, (F.col("first_before") + F.col("bins_before") + F.col("bin")).alias("sequence_id"),
        (F.col("nth") * F.col("length")).alias("offset"), ids,
    )
    rank = F.col("left_before") + F.col("nth")
    left = joined.filter(F.col("bin").isNull()).withColumn("rank", rank)
    in_bin = F.col("rank") < F.col("class_second") * F.col("class")
    second = left.filter(in_bin).select(
        *kept, (first_bins + F.col("second_before") + F.floor(F.col("rank") / F.col("class"))).alias("sequence_id"),
        (F.col("rank") % F.col("class") * F.col("length")).alias("offset"), ids,
    )
    over = F.col("rank") - F.col("class_second") * F.col("class")
    stream = left.filter(~in_bin).select(*kept, (F.col("last_before") + over * F.col("length")).alias("at"), "ids")
    base = first_bins + second_bins
    ends = last_ends(last_tokens, capacity)
    full = last_tokens // capacity
    schema = first.schema
    out_schema = arrow_schema(schema)

    def cut_stream(batches):
        bounds = np.array([capacity * (i + 1) for i in range(full)] + ends, np.int64)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                at, stop = row["at"], row["at"] + row["length"]
                begin = at
                while at < stop:
                    number = int(np.searchsorted(bounds, at, "right"))
                    until = min(stop, int(bounds[number]))
                    part = row["ids"][4 * (at - begin) : 4 * (until - begin)]
                    offset = at - (int(bounds[number - 1]) if number else 0)
                    start = row["start"] + at - begin
                    out.append(
                        (row["id"], start, until - at, zlib.crc32(part), row["doc_tokens"], base + number, offset,
                         part if with_ids else None)
                    )
                    at = until
            if out:
                columns = zip(*out, strict=True)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    packed = first.unionByName(second).unionByName(stream.mapInArrow(cut_stream, schema))
    packed = packed if with_ids else packed.drop("ids")
    return packed.withColumnRenamed("id", id_col)
