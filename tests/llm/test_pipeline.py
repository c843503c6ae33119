import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from starloom.llm.common import read_table
from starloom.llm.harmonic import harmonic_packing
from starloom.llm.importance import importance_resample
from starloom.llm.language import learn
from starloom.llm.pfair import mix_sources, mix_to_end
from starloom.llm.queries import ORACLE, QUERIES
from starloom.scratch import staged
from tests.conftest import SMALL
from tests.llm.conftest import ODD_ROWS
from tests.llm.test_near_duplicates import groups, plain_simhash


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_follow_each_other(spark, documents):
    kept = documents
    for name, stage in corpus_pipeline.STAGES:
        before, after = by_id(kept), stage(spark, kept, SMALL)
        if name == "packing":
            break
        assert after.columns == documents.columns and after.schema.simpleString() == documents.schema.simpleString()
        after = staged(after, "test")
        found = by_id(after)
        assert found.items() <= before.items() and after.count() == len(found)
        if name == "language_id":
            network = learn(documents)
            langs, scores = network.predict([r.text.encode() for r in before.values()])
            want = {d for d, s in zip(before, scores, strict=True) if s >= corpus_pipeline.LEAST_SCORE and any(map(str.isalpha, before[d].text))}
        elif name == "quality":
            want = {r.doc_id for r in importance_resample(kept, read_table(spark, SMALL, "labels")).collect() if r.kept}
        elif name == "near_duplicates":
            ids = sorted(before)
            prints = np.array([plain_simhash(before[d].text, 4) for d in ids], np.uint64)
            near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
            want = {ids[g] for g in groups(len(ids), near.tolist())}
            assert len(want) < len(ids)
        else:
            want = set(before)
            slots = {r.doc_id: r.slot for r in mix_to_end(kept).collect()}
            order = [slots[r.doc_id] for r in stage(spark, kept, SMALL).collect()]
            assert order == sorted(order)
        assert set(found) == want, name
        kept = after
    columns = ["doc_id", "start", "length", "ids_crc32"]
    packed = sorted(map(tuple, after.select(columns).collect()))
    assert packed == sorted(map(tuple, harmonic_packing(kept, "word_bpe_49k.json", 2).select(columns).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select(columns).collect())) == packed


def test_mixed_documents_are_written_in_the_order_of_their_slots(spark, documents):
    slots = {r.doc_id: r.slot for r in mix_sources(documents, block_bytes=1 << 16).collect()}
    mixed = corpus_pipeline.mixing_stage(spark, documents, SMALL)
    order = [slots[r.doc_id] for r in mixed.collect()]
    assert order == sorted(order)


def test_mixing_keeps_documents_after_the_smallest_source_is_out(spark):
    rows = [(i, f"document {i} " * 3000, "en", "large", 7) for i in range(200)] + [(1000, "the only one", "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `SHARD` int").repartition(3)
    mixed = corpus_pipeline.mixing_stage(spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(r[0] for r in rows)
    assert not all(r.in_mix for r in mix_sources(docs).collect())


def test_pipeline_packs_every_document_that_reaches_the_mix(spark, documents):
    kept = documents
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = staged(stage(spark, kept, SMALL), "test")
    columns = ["doc_id", "start", "length", "ids_crc32"]
    mixed = staged(corpus_pipeline.mixing_stage(spark, kept, SMALL), "test")
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, kept.collect()))
    want = sorted(map(tuple, harmonic_packing(mixed, "word_bpe_49k.json", 2).select(columns).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).select(columns).collect())) == want


def test_one_of_each_group_stays_of_odd_rows(spark, odd):
    kept = corpus_pipeline.near_duplicate_stage(spark, odd, SMALL)
    assert kept.columns == odd.columns
    rows = kept.collect()
    # The null text, the empty one and the blanks are alike; so are rows that repeat.
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 4, 5, 5, 6]
    assert len([r for r in rows if r.doc_id is None]) == 1
    assert {r.text for r in rows if r.doc_id == 5} == {t for i, t, *_ in ODD_ROWS if i == 5}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_documents_and_clashing_names(spark, odd, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, nothing, SMALL).collect() == []
    clashing = odd.withColumnsRenamed({"SHARD": "FOUND"})
    for c in ("chosen_doc_id", "chosen_tie", "chosen_slot", "chosen_times", "tie", "id"):
        clashing = clashing.withColumn(c, clashing["FOUND"])
    result = stage(spark, clashing, SMALL)
    assert name == "packing" or result.columns == clashing.columns
    assert result.count() == clashing.count() if name == "mixing" else not result.isEmpty()


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb

    from verify_local import _rows

    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    got, want = QUERIES[name](spark, SMALL), db.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())
