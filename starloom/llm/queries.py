"""One query per operator, over its whole table, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm.best_position import lexical_search
from starloom.llm.bisection import target_resample
from starloom.llm.common import read_table, ship_package
from starloom.llm.harmonic import harmonic_packing
from starloom.llm.importance import importance_resample
from starloom.llm.language import identify_languages
from starloom.llm.line_runs import dedup_lines
from starloom.llm.oracle import BEST_POSITION, BISECTION, EMBEDDING_GROUPS, LINE_RUNS, PFAIR_MIX
from starloom.llm.pfair import mix_sources
from starloom.llm.rotation_codes import embedding_groups
from starloom.llm.simhash import simhash_groups
from starloom.llm.syncmers import document_fingerprints
from starloom.llm.token_counts import token_counts
from starloom.llm.virtual_slots import slot_bytes, update_map, virtual_shards, with_slots
from starloom.llm.wavelet import read_files, write_files
from starloom.scratch import scratch_path

END_ID = 2
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints(read_table(spark, sf_dir, "documents"))


def op2_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(read_table(spark, sf_dir, "embeddings"), 0.93)


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = read_table(spark, sf_dir, "documents"), scratch_path(spark, "slot-map")
    # A map that is there for 23 shards is edited for the 24th: rows are placed by its second version.
    update_map(slot_bytes(with_slots(docs)), 23, path)
    shards = virtual_shards(docs, 24, path)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return importance_resample(docs, labels).drop("tie")


def op5_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).drop("tie")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_harmonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_packing(read_table(spark, sf_dir, "documents"), WORDS, END_ID)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(read_table(spark, sf_dir, "documents"))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "wavelet")
    write_files(read_table(spark, sf_dir, "documents"), path, BYTES, END_ID)
    return read_files(spark, path)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), WORDS)


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = dedup_lines(read_table(spark, sf_dir, "documents"), scratch_path(spark, "line-runs"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


_ALL = (
    op1_syncmers, op2_rotation_codes, op3_virtual_slots, op4_importance, op5_pfair, op6_simhash, op7_harmonic,
    op8_language, op9_wavelet, op10_token_counts, op11_best_position, op12_bisection, op13_line_runs,
)

QUERIES = {query.__name__: _shipped(query) for query in _ALL} | {"pipeline": corpus_pipeline.run}

#: Without SQL, and tested against brute force: what needs xxHash64, crc32, tokenizers or a trained model.
ORACLE = {
    "op2_rotation_codes": EMBEDDING_GROUPS, "op5_pfair": PFAIR_MIX, "op11_best_position": BEST_POSITION,
    "op12_bisection": BISECTION, "op13_line_runs": LINE_RUNS,
}
