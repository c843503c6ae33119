"""Importance resampling to a target distribution: scores from arrays, then a cutoff found by bisection.

Texts and target texts are counted into the same buckets; a bucket's gain compares the two. A document's weight adds up its
features' gains, Gumbel noise from a hash of its id makes the highest scores a sample without replacement. Which
scores are the highest is found without sorting: scores are written once, and jobs that count the rows up to given
values close in on the cutoff, first of the score, then of the id among rows that tie with it. Only rows up to the
cutoff are sorted into ranges for their ranks.
"""

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from starloom.llm.common import arrow_batches, arrow_schema, ddl, running_before, written_in_order
from starloom.llm.words import word_lists
from starloom.scratch import staged

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 2024
SECTIONS = 16  # of an interval per count job
KNOWN = 1 << 18  # features whose bucket a worker remembers
BATCH_BYTES = 6 << 20


class Buckets(dict):
    """Buckets of features, remembered."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = found = crc32(feature) % self.buckets
        return found


def feature_buckets(text: bytes, known: Buckets, longest: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """Part by part of the text, the number of its words and the buckets of all runs of 1 to ``longest`` of them."""
    held: list[bytes] = []  # the last words of the part before, which runs may begin with
    for words in word_lists(text):
        both = held + words
        features = list(words)
        for n in range(2, longest + 1):
            first = max(0, len(held) - n + 1)
            features += [b" ".join(both[i : i + n]) for i in range(first, len(both) - n + 1)]
        yield len(words), np.fromiter(map(known.__getitem__, features), np.int64, len(features))
        held = both[len(both) - longest + 1 :] if longest > 1 else []


def bucket_counts(rows: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features per bucket in all ``text`` values. Every task sends at most one row per bucket."""
    schema = "bucket int, n bigint"
    out_schema = arrow_schema(schema)

    def count(batches):
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                for _, own in feature_buckets(text.as_py().encode(), known, longest):
                    total += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], schema=out_schema)

    total = np.zeros(buckets, np.int64)
    with arrow_batches(rows.sparkSession, BATCH_BYTES):
        for row in rows.mapInArrow(count, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
            total[row.bucket] = row.n
    return total


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln) of its share of the target's features over its share of the raw ones, both plus one each."""
    size, raw_size, target_size = len(raw), int(raw.sum()), int(target.sum())
    pairs = zip(raw.tolist(), target.tolist(), strict=True)
    gains = [math.floor(1000 * math.log((t + 1) * (raw_size + size) / ((s + 1) * (target_size + size)))) for s, t in pairs]
    return np.array(gains, np.int64)


def _weighed(rows: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """``n_words``, ``n_features`` and ``weight`` (the sum of the features' gains) in place of ``text``."""
    schema = f"{ddl(rows, id='id', tie='tie')}, n_words bigint, n_features bigint, weight bigint"
    out_schema = arrow_schema(schema)

    def weigh(batches):
        known = Buckets(len(gains))
        for batch in batches:
            found = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column("text")):
                for n_words, own in feature_buckets(text.as_py().encode(), known, longest):
                    found[:, i] += n_words, len(own), gains[own].sum()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("tie"), *map(pa.array, found)], schema=out_schema)

    return rows.mapInArrow(weigh, schema)


def cutoff(rows: DataFrame, keys: list[str], size: int, sections: int = SECTIONS) -> Column:
    """A condition that holds for the first ``size`` rows (1 at least, all at most) by ascending ``keys``, long columns.

    For each key in turn, among the rows that tie in the keys before: jobs count the rows up to ``sections`` - 1 values
    inside the interval where the cutoff must lie, until one value is left. The next key is looked at only if that
    value has more rows than are still wanted. Rows that tie in all keys are all taken.
    """
    tied, taken, wanted = F.lit(True), F.lit(False), size
    for key in keys:
        own = rows.filter(tied)
        low, high = own.agg(F.min(key), F.max(key)).first()
        before, upto = 0, own.count()
        while low < high:
            at = sorted({low + (high - low) * n // sections for n in range(sections)} - {high})
            counts = own.agg(*[F.count_if(F.col(key) <= v) for v in at]).first()
            reached = [(v, n) for v, n in zip(at, counts, strict=True) if n >= wanted]
            missed = [(v, n) for v, n in zip(at, counts, strict=True) if n < wanted]
            if reached:
                high, upto = reached[0]
            if missed:
                low, before = missed[-1][0] + 1, missed[-1][1]
        taken = taken | (tied & (F.col(key) < low))
        tied = tied & (F.col(key) == low)
        wanted -= before
        if upto - before <= wanted:
            break
    return taken | tied


def target_resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = LEAST_WORDS, longest: int = 1,
    buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Draw ``percent`` of every hundred documents that have ``least_words`` words, towards the ``target`` texts.

    Words are those of ``words.word_lists``, features all runs of 1 to ``longest`` words joined by a blank, repeats counted,
    and a feature's bucket the crc32 of its bytes modulo ``buckets``. The score is the sum of the features' gains plus
    floor(-1000 ln(-ln u)), u being taken from the first 32 bits of sha256 of ``<seed>:<id>``.

    Returns per row the id, ``tie`` (a hash of the text), ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``: from 1 by falling
    score, then rising id, then ``tie``, for the rows drawn; null for the others. All documents count for the models, also those
    with too few words to be drawn.

    The id must be a whole number. A null id draws its noise from the text's hash instead, and ranks last among equal scores.
    Rows with equal ids share their noise and are drawn as rows of their own, each copy counted. A null or empty text has no
    features and weighs 0. Without target texts gains come from the raw counts alone. Other columns are not
    read. An empty table, or fewer rows than make up one drawn, gives no ranks.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    wanted = target.filter(F.col(target_col).isNotNull()).select(F.col(target_col).alias("text"))
    gains = bucket_gains(bucket_counts(rows.select("text"), buckets, longest), bucket_counts(wanted, buckets, longest))
    named = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null:"), F.col("tie").cast("string")))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), named), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        weighed = _weighed(rows, gains, longest).withColumn("score", score)
        # ``row`` tells copies apart once it is written.
        weighed = staged(weighed.withColumn("row", F.monotonically_increasing_id()), "bisection-scores")
    keyed = weighed.withColumns({"falling": -F.col("score"), "own": F.coalesce(F.col("id").cast("long"), F.lit(2**63 - 1))})
    able = keyed.filter(F.col("n_words") >= least_words)
    size = percent * able.count() // 100
    columns = [F.col("id").alias(id_col), "tie", "n_words", "n_features", "weight", "score"]
    if not size:
        return weighed.select(*columns, F.lit(None).cast("long").alias("rank"))
    keys = ["falling", "own", "tie", "row"]
    drawn = (F.col("n_words") >= least_words) & cutoff(able, keys, size)
    ranges = written_in_order(keyed.filter(drawn), keys, "bisection-drawn")
    parts = running_before(ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "n", "before", ["part"])
    ranked = ranges.join(parts.select(F.col("part").alias("p"), "before"), F.col("part") == F.col("p"))
    ranked = ranked.select(*columns, (F.col("before") + F.col("place") + 1).alias("rank"))
    return ranked.unionAll(keyed.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
