"""Importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import arrow_batches, arrow_schema, ddl, running_before, written_in_order
from starloom.llm.ngrams import hashed_ngrams
from starloom.scratch import staged

BUCKETS = 1 << 12
LABELLED = 8192
SMOOTHING = 0.3
GOOD_WEIGHT = 3.0
BYTES_AT_ONCE = 1 << 18  # a dozen arrays of eight times as much are in work
BATCH_BYTES = 6 << 20


def _joined(texts: list[bytes]):
    """Texts in groups of about ``BYTES_AT_ONCE``, each as (first index, bytes with a line feed after each, their ends)."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text) + 1
        if size >= BYTES_AT_ONCE or i == len(texts) - 1:
            ends = np.cumsum([len(t) + 1 for t in held])
            yield first, np.frombuffer(b"\n".join(held) + b"\n", np.uint8), ends
            first, held, size = i + 1, [], 0


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.binary()).to_pylist()


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, limit: int = LABELLED) -> DataFrame:
    """``key``, ``target`` and ``fits`` of at most ``limit`` labelled ids, chosen by a hash of the id; 1 is the target.

    ``fits`` marks three quarters, to fit the model; the others are kept to find where it divides. Rows
    with a null id or label are left out; an id labelled both ways is none of the target.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    by_id = known.groupBy(F.col(id_col).alias("key")).agg((F.min(label_col) > 0).alias("target"))
    chosen = by_id.withColumn("spread", F.xxhash64(F.col("key").cast("string"), F.lit("labelled sample")))
    chosen = chosen.orderBy("spread", "key").limit(limit)
    return chosen.select("key", "target", (F.pmod("spread", F.lit(4)) != 0).alias("fits"))


def ngram_counts(rows: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """N-grams per bucket in all texts, and in those whose ``model`` is true. Every task sends a row per bucket."""
    schema = "bucket int, every bigint, target bigint"
    out_schema = arrow_schema(schema)

    def count(batches):
        every, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            wanted = np.array([bool(t) for t in batch.column("model").to_pylist()], bool)
            for first, data, ends in _joined(_bytes_of(batch.column("text"))):
                bucket, text = hashed_ngrams(data, ends, buckets)
                every += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[wanted[first + text]], minlength=buckets)
        used = np.flatnonzero(every)
        columns = [pa.array(used, pa.int32()), pa.array(every[used]), pa.array(target[used])]
        yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    partial = rows.select("text", "model").mapInArrow(count, schema)
    sums = partial.groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("target").alias("target"))
    every, target = np.zeros(buckets), np.zeros(buckets)
    for row in sums.collect():  # at most ``buckets`` rows
        every[row.bucket], target[row.bucket] = row.every, row.target
    return every, target


def log_ratios(every: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the logarithm of its probability in the target over that in the raw text; 0 without a target.

    The target model is smoothed with ``SMOOTHING`` times its size of raw text, so that few labelled documents
    do not make rare n-grams look bad; the raw model with half an n-gram a bucket.
    """
    size = target.sum()
    if not size:
        return np.zeros(len(every))
    raw = (every + 0.5) / (every.sum() + 0.5 * len(every))
    return np.log((target + SMOOTHING * size * raw) / ((1 + SMOOTHING) * size * raw))


def weighted(rows: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``log_weight`` instead of ``text``: the sum of the ratios of all its n-grams, 0 for a text without any."""
    schema = f"{ddl(rows, id='id', tie='tie')}, target boolean, fits boolean, log_weight double"
    out_schema = arrow_schema(schema)

    def weigh(batches):
        for batch in batches:
            weights = np.zeros(batch.num_rows)
            for first, data, ends in _joined(_bytes_of(batch.column("text"))):
                bucket, text = hashed_ngrams(data, ends, len(ratios))
                weights[first : first + len(ends)] = np.bincount(text, ratios[bucket], minlength=len(ends))
            kept = [batch.column(c) for c in ("id", "tie", "target", "fits")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(weights)], schema=out_schema)

    return rows.select("id", "tie", "target", "fits", "text").mapInArrow(weigh, schema)


def dividing_weight(good: np.ndarray, bad: np.ndarray) -> float:
    """The weight that best divides labelled documents, midway between the two that it divides.

    Best is the largest difference of the part of the target that is kept, ``GOOD_WEIGHT`` times, and the part of the others.
    Without documents of one label, the lowest weight of the target but 0 at most, or no bound.
    """
    if not len(good):
        return -np.inf
    if not len(bad):
        return float(min(0.0, good.min()))
    values = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
    kept_good = 1 - np.searchsorted(np.sort(good), cuts, "left") / len(good)
    kept_bad = 1 - np.searchsorted(np.sort(bad), cuts, "left") / len(bad)
    return float(cuts[np.argmax(GOOD_WEIGHT * kept_good - kept_bad)])


def importance_resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    size: int | None = None, labelled: int = LABELLED, buckets: int = BUCKETS,
) -> DataFrame:
    """Resample ``docs`` towards the texts whose label is 1.

    The target model is fitted on three quarters of at most ``labelled`` labelled documents, the raw model on all documents. A document's
    log weight is the log of the ratio of the two models over all its n-grams; Gumbel noise, drawn from a hash of the id,
    is added, and the ``size`` largest sums stay: a sample without replacement in proportion to the weights. Without
    ``size`` as many stay as have a weight on the target's side of the other labelled documents (see ``dividing_weight``).

    Returns per row the id, ``tie`` (a hash of the text), ``log_weight``, ``gumbel_weight``, ``rank`` (from 0) and ``kept``.
    A null text counts as empty and weighs 0. Null ids match no label and draw their noise from the text's hash. Rows with
    equal ids are weighed as rows of their own with the same noise, so that a document is drawn or not whichever of its versions it is; equal sums are ranked by id and ``tie``. Other columns are not read. Without labels of the target
    all weights are 0 and, unless ``size`` says otherwise, all rows stay. An empty table gives an empty result.
    """
    sample = staged(labelled_sample(labels, id_col, label_col, labelled), "importance-labels")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    rows = rows.join(sample, F.col("id") == F.col("key"), "left").select(
        "id", "tie", "text", "target", "fits", (F.col("target") & F.col("fits")).alias("model")
    )
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        every, target = ngram_counts(rows, buckets)
    drawn_from = F.coalesce(F.col("id").cast("string"), F.concat(F.lit("null "), F.col("tie").cast("string")))
    uniform = (F.xxhash64(F.lit("gumbel"), drawn_from).cast("double") + 2.0**63 + 1024) / (2.0**64 + 4096)
    gumbel = F.col("log_weight") - F.log(-F.log(uniform))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        sums = staged(weighted(rows, log_ratios(every, target)).withColumn("gumbel_weight", gumbel), "importance-weights")
    if size is None:
        known = sums.filter("target IS NOT NULL AND NOT fits").select("target", "log_weight").collect()  # bounded sample
        good, bad = (np.array([r.log_weight for r in known if r.target == t]) for t in (True, False))
        size = sums.filter(F.col("log_weight") >= F.lit(dividing_weight(good, bad))).count()
    order = [F.desc("gumbel_weight"), F.asc("id"), F.asc("tie")]
    ranked = written_in_order(sums.drop("target", "fits"), order, "importance-order")
    parts = running_before(ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "n", "before", ["part"])
    ranked = ranked.join(parts.select(F.col("part").alias("p"), "before"), F.col("part") == F.col("p"))
    return ranked.withColumn("rank", F.col("before") + F.col("place")).select(
        F.col("id").alias(id_col), "tie", "log_weight", "gumbel_weight", "rank", (F.col("rank") < size).alias("kept")
    )
