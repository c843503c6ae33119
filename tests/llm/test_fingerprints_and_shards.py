import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.llm import syncmers, virtual_slots
from starloom.llm.queries import QUERIES
from starloom.llm.syncmers import anchors, as_text, code_points, document_fingerprints, fingerprint, from_text, likeness
from starloom.llm.virtual_slots import edited_map, read_map, slot_bytes, store_map, virtual_shards, with_slots
from starloom.scratch import scratch_path
from tests.conftest import SMALL
from tests.llm.conftest import ODD_ROWS


def plain_syncmers(points, k, s):
    """Places of the windows whose smallest inner hash is at an edge, one window at a time."""
    def hashed(window):
        value = 0
        for c in window:
            value = (value * int(syncmers.BASE) + int(c) + 1) % 2**64
        return int(syncmers._mixed(np.array([value], np.uint64))[0])

    places = []
    for at in range(len(points) - k + 1):
        inner = [hashed(points[at + i : at + i + s]) for i in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            places.append(at)
    return places


@settings(max_examples=40, deadline=None)
@given(st.text(st.sampled_from("ab é\U0001d538"), min_size=16, max_size=120))
def test_anchors_are_closed_syncmers(text):
    points = code_points(text)
    assert anchors(points)[1].tolist() == plain_syncmers(points.tolist(), 16, 9)


def test_anchors_do_not_depend_on_the_context_or_chunks(monkeypatch, texts):
    text = max(texts.values(), key=len)[:3000]
    whole = anchors(code_points(text))
    shifted = anchors(code_points("x" * 500 + text))
    kept = shifted[1] >= 500
    assert (shifted[1][kept] - 500).tolist() == whole[1].tolist() and (shifted[0][kept] == whole[0]).all()
    assert np.diff(whole[1]).max() <= 16 - 9
    monkeypatch.setattr(syncmers, "CHUNK", 97)
    assert [x.tolist() for x in anchors(code_points(text))] == [x.tolist() for x in whole]


def test_likeness():
    a, b = (fingerprint(code_points(t)) for t in ("the quick brown fox jumps over the lazy dog " * 9, "quite another text, no doubt " * 9))
    empty = fingerprint(code_points(""))
    assert likeness(a, a) == 1 and likeness(a, b) == 0 and likeness(empty, empty) == 1 and likeness(a, empty) == 0
    assert (from_text(as_text(a)) == a).all()


def test_a_passage_in_two_long_texts_is_found():
    draw = np.random.default_rng(5)

    def letters(n):
        return "".join(map(chr, draw.integers(97, 123, n)))

    for _ in range(10):
        passage, (at, to) = letters(1_200), draw.integers(0, 118_000, 2).tolist()
        a, b = letters(118_800), letters(118_800)
        one, other = (fingerprint(code_points(t[:i] + passage + t[i:])) for t, i in ((a, at), (b, to)))
        _, of_a, of_b = np.intersect1d(one["hash"], other["hash"], return_indices=True)
        apart = other["place"][of_b].astype(int) - one["place"][of_a].astype(int)
        assert (apart == to - at).sum() >= 2
        assert likeness(one, other) > 0
        assert likeness(one, fingerprint(code_points(a))) > 0.9


def test_rows_of_one_id_and_of_none_are_spread(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} " * 3) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        out = document_fingerprints(frame)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        got = out.groupBy("doc_id").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) == 12 and sum(sizes) == 3000 and max(sizes) < 2 * np.median(sizes)
    assert {r.doc_id: r["count"] for r in got if r.doc_id in (None, 7)} == {None: 1000, 7: 1000}


def plain_fingerprints(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for (doc_id, text), (_, next_text) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + next_text[:half]
        own, changed, following = (fingerprint(code_points(t)) for t in (text, edited, next_text))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out[doc_id] = (len(text), digest, as_text(own), as_text(changed), likeness(own, changed), likeness(own, following))
    return out


def found(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_document_fingerprints(documents, texts):
    got = found(document_fingerprints(documents.repartition(3)))
    assert got == plain_fingerprints(list(texts.items()))
    near = np.array([v[4:] for v in got.values() if v[0] > 200])
    assert 0.2 < np.median(near[:, 0]) < 0.5 and np.median(near[:, 1]) < 0.05


@pytest.mark.parametrize("rows", [[], [(5, "abc" * 20)], [(1, "é" * 40), (None, "x" * 50), (5, None), (-7, "")]])
def test_few_documents(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = plain_fingerprints([(i, t or "") for i, t in rows]) if rows else {}
    assert found(document_fingerprints(frame)) == want


def test_odd_documents(odd):
    rows = document_fingerprints(odd).collect()
    assert sorted(r.n_chars for r in rows) == sorted(len(r[1] or "") for r in ODD_ROWS)
    same = {r.fingerprint for r in rows if r.doc_id == 5 and r.n_chars == len(ODD_ROWS[6][1])}
    assert len(same) == 1


def check_shards(rows, docs, shards):
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs
    )
    slots: dict = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("cell_rows", [1 << 18, 1])
def test_shards(monkeypatch, spark, documents, texts, cell_rows):
    monkeypatch.setattr(virtual_slots, "CELL_ROWS", cell_rows)
    rows = virtual_shards(documents, 6, scratch_path(spark, "map"), slots=64).collect()
    check_shards(rows, list(texts.items()), 6)
    assert all(len({r.shard for r in rows if r.virtual_slot == v}) == 1 for v in {r.virtual_slot for r in rows})
    if cell_rows == 1:  # the places do not depend on how many cells a slot is cut into
        monkeypatch.setattr(virtual_slots, "CELL_ROWS", 1 << 18)
        again = virtual_shards(documents, 6, scratch_path(spark, "map"), slots=64).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_shards_of_odd_rows(spark, odd, nothing):
    rows = virtual_shards(odd, 4, scratch_path(spark, "map")).collect()
    check_shards(rows, [r[:2] for r in ODD_ROWS], 4)
    assert virtual_shards(nothing, 4, scratch_path(spark, "map")).collect() == []


def test_rebalancing_makes_a_new_version(spark, documents):
    path = scratch_path(spark, "map")
    rows = virtual_shards(documents, 6, path, slots=512).collect()
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    assert max(size.values()) < 1.02 * sum(size.values()) / 6
    sizes = slot_bytes(with_slots(documents, slots=512))
    first = read_map(spark, path)
    store_map(edited_map(sizes, 7, first, slots=512), path)
    before = {r.virtual_slot: r.shard for r in read_map(spark, path, 0).collect()}
    after = {r.virtual_slot: (r.shard, r.bytes) for r in read_map(spark, path).collect()}
    moved = [v for v in before if before[v] != after[v][0]]
    assert moved and {after[v][0] for v in moved} == {6}
    assert len(after) == 512 and sum(after[v][1] for v in moved) <= sum(size.values()) / 7 + 1
    store_map(edited_map(sizes, 5, read_map(spark, path), slots=512), path)
    fewer = read_map(spark, path)
    assert {r.shard for r in fewer.collect()} == set(range(5)) and fewer.first().version == 2
    unchanged = edited_map(sizes, 5, fewer, slots=512).collect()
    assert {r.virtual_slot: r.shard for r in unchanged} == {r.virtual_slot: r.shard for r in fewer.collect()}


def test_shards_follow_the_stored_map(spark, documents, texts):
    path = scratch_path(spark, "map")

    def placed(shards):
        rows = virtual_shards(documents, shards, path, slots=512).collect()
        check_shards(rows, list(texts.items()), shards)
        maps = Counter(r.version for r in spark.read.parquet(path).collect())
        assert set(maps.values()) == {512} and {r.map_version for r in rows} == {max(maps)}
        return {r.doc_id: r.shard for r in rows}, len(maps)

    first, again, grown, fewer = placed(6), placed(6), placed(7), placed(5)
    assert first[1] == 1 and again == first
    moved = {d for d in first[0] if first[0][d] != grown[0][d]}
    assert grown[1] == 2 and moved and {grown[0][d] for d in moved} == {6}
    assert fewer[1] == 3 and set(fewer[0].values()) == set(range(5))
    with pytest.raises(ValueError, match="512 slots"):
        virtual_shards(documents, 5, path, slots=64)


def test_a_third_on_one_id_and_a_third_without_keep_shards_even(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "same" * 25 if i % 2 else f"text {i} " * 12) for i in range(30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = virtual_shards(docs, 24, scratch_path(spark, "map"))
    assert out.count() == len(rows)
    held = [r.b for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(held) == 24 and max(held) < 1.02 * sum(held) / 24 and min(held) > 0.98 * sum(held) / 24
    slots = out.groupBy("shard").agg(F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("n"))
    assert all((r.low, r.high) == (0, r.n - 1) for r in slots.collect())


def test_the_query_places_rows_by_an_edited_map(spark, documents):
    rows = QUERIES["op3_virtual_slots"](spark, SMALL).collect()
    assert {r.map_version for r in rows} == {1} and len(rows) == documents.count()
    assert {r.shard for r in rows} == set(range(24))
