"""The corpus pipeline: documents in, packed token sequences out, in five stages.

Every stage works on all rows its predecessor kept. The first four return the columns of the documents they were given.
A row is known by its id and a hash of its text (both may be null), so rows without an id and rows that share one are
each judged; rows equal in both share their fate, but only one of them stays in near-duplicate removal. An empty table
passes through all stages.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import fresh, read_table, ship_package, table_parts
from starloom.llm.harmonic import harmonic_packing
from starloom.llm.importance import importance_resample
from starloom.llm.language import learn, predicted
from starloom.llm.pfair import mix_to_end
from starloom.llm.simhash import simhash_groups
from starloom.scratch import staged

LEAST_SCORE = 0.5  # of a language against all others and none of them
SHINGLE, RADIUS = 4, 4
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def _tie() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _only(docs: DataFrame, chosen: DataFrame, *more: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows of ``docs`` whose (id, hash of the text) is in ``chosen`` (columns ``doc_id``, ``tie``, each pair once).

    Columns ``more`` of ``chosen`` come along under the returned names.
    """
    own = {c: fresh(docs, f"chosen_{c}") for c in ("doc_id", "tie", *more)}
    chosen = chosen.select(*[F.col(c).alias(new) for c, new in own.items()])
    same = docs["doc_id"].eqNullSafe(chosen[own["doc_id"]]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == chosen[own["tie"]])
    if not more:
        return docs.join(chosen, same, "left_semi"), own
    return docs.join(chosen, same).drop(own["doc_id"], own["tie"]), own


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that the network takes for no language more than for any."""
    ship_package(spark)
    found = fresh(docs, "found")
    known = docs.withColumn(found, predicted(learn(docs)))
    return known.filter((F.col(found)["lang"] != "und") & (F.col(found)["score"] >= LEAST_SCORE)).drop(found)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling towards the good labelled documents samples."""
    ship_package(spark)
    weighed = importance_resample(docs, read_table(spark, sf_dir, "labels"))
    return _only(docs, weighed.filter("kept").select("doc_id", "tie").distinct())[0]


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group: the smallest id, of several texts with it the one of smallest hash."""
    ship_package(spark)
    groups = simhash_groups(docs, SHINGLE, RADIUS)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group", "doc_id", "tie").count()
    one = first.groupBy("group").agg(F.min(F.struct("tie", "doc_id", "count")).alias("one"))
    chosen = staged(one.select("one.doc_id", "one.tie", F.col("one.count").alias("times")), "pipeline-first")
    kept, own = _only(docs, chosen, "times")
    # Rows that repeat in full are few as a rule; only they are gathered to drop all but one of each.
    repeated = kept.filter(F.col(own["times"]) > 1).withColumn(own["tie"], _tie())
    repeated = repeated.dropDuplicates(["doc_id", own["tie"]]).drop(own["tie"])
    return kept.filter(F.col(own["times"]) == 1).unionByName(repeated).drop(own["times"])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, written in the order of their slots in a mix that goes on until every source is out."""
    ship_package(spark)
    mix = mix_to_end(docs).groupBy("doc_id", "tie").agg(F.min("slot").alias("slot"))
    mix = staged(mix, "pipeline-mix")
    kept, own = _only(docs, mix, "slot")
    slot, parts = own["slot"], table_parts(docs)
    # Slots are dense and of about equal bytes, so ranges of them need no sample of the texts.
    last = mix.agg(F.coalesce(F.max("slot"), F.lit(0))).first()[0]
    placed = kept.repartitionById(parts, F.floor(F.col(slot) * parts / F.lit(last + 1)).cast("int"))
    return placed.sortWithinPartitions(slot, "doc_id").drop(slot)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed token sequences."""
    ship_package(spark)
    return harmonic_packing(docs, TOKENIZER, END_ID)


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the network nor the n-gram models; tests/llm/test_pipeline.py follows the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, f"pipeline-{name}")
    return docs
