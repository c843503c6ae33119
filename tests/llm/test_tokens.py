import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starloom.llm import tokens
from starloom.llm.harmonic import cuts, harmonic_packing, last_ends
from starloom.llm.token_counts import token_counts
from starloom.llm.wavelet import WaveletFile, count_tokens, find_token, pack, read_files, write_files
from starloom.scratch import scratch_path
from tests.llm.conftest import ODD_ROWS

VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
LIBRARY = {v: Tokenizer.from_file(public_tokenizers.path(v)) for v in VOCABULARIES}
TRICKY = st.sampled_from(
    list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ᠎ ​ 　﻿́aZéİΣß1٣!'’.,$")
    + ["<|endoftext|>", "<|startoftext|>", "'s", "'ll", " word", " two words", "\n\n", "  "]
)


def ids_of(vocabulary, text):
    return LIBRARY[vocabulary].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("vocabulary", VOCABULARIES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(TRICKY, max_size=20).map("".join), max_size=30))
def test_ids_and_counts_are_the_librarys(vocabulary, texts):
    own = tokens.encoder(vocabulary)
    array = pa.array(texts, pa.string())
    want = [ids_of(vocabulary, t) for t in texts]
    assert [i.tolist() for i in own.ids(array)] == want
    assert own.counts(array).tolist() == [len(w) for w in want]


def test_forgetting_and_small_batches_change_nothing(monkeypatch, texts):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 3000)
    own = tokens.PieceEncoder(VOCABULARIES[0])
    some = list(texts.values())[:40]
    assert [i.tolist() for i in own.ids(pa.array(some))] == [ids_of(VOCABULARIES[0], t) for t in some]


def test_piece_model_counts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    some = ["", "a b  c", "été\n"]
    assert tokens.encoder("piece_bpe_32k.model").counts(pa.array(some)).tolist() == [len(model.encode(t)) for t in some]


@pytest.mark.parametrize("vocabulary", VOCABULARIES)
def test_token_counts(odd, documents, texts, vocabulary):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(documents, vocabulary).collect()}
    assert got == {
        d: (len(t.encode()), n := len(ids_of(vocabulary, t)), n > 2048) for d, t in texts.items()
    }
    want = sorted((repr(d), len((t or "").encode()), len(ids_of(vocabulary, t))) for d, t, *_ in ODD_ROWS)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts(odd, vocabulary).collect()) == want


def test_no_rows(nothing, spark):
    assert token_counts(nothing, VOCABULARIES[0]).collect() == []
    assert harmonic_packing(nothing, VOCABULARIES[1], 2).collect() == []
    path = scratch_path(spark, "no-files")
    write_files(nothing, path, VOCABULARIES[0], 2)
    assert read_files(spark, path).collect() == []
    assert [tuple(r) for r in count_tokens(spark, path, [2]).collect()] == [(2, 0)]
    assert find_token(spark, path, 2).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(6, 9))
def test_wavelet_file(ids, planes):
    data = np.array(ids, np.uint32)
    file = WaveletFile(pack(data, np.array([len(ids)]), planes))
    assert file.all().tolist() == ids and file.lengths.tolist() == [len(ids)]
    assert [file.access(i) for i in range(len(ids))] == ids
    for token in {0, 41, *ids[:5]}:
        places = [i for i, x in enumerate(ids) if x == token]
        assert file.count(token) == len(places)
        assert file.count(token, 3, max(3, len(ids) - 2)) == sum(3 <= p < len(ids) - 2 for p in places)
        assert [file.occurrence(token, n) for n in range(len(places))] == places


def test_wavelet_file_of_several_blocks():
    data = np.random.default_rng(0).integers(0, 50257, 200_000).astype(np.uint32)
    data[60_000:140_000] = 7
    file = WaveletFile(pack(data, np.array([200_000]), 16))
    assert (file.all() == data).all()
    for at in (0, 65_535, 65_536, 131_072, 199_999):
        assert file.access(at) == data[at]
    places = np.flatnonzero(data == 7)
    assert file.count(7) == len(places) and file.count(7, 65_536, 131_072) == 65_536
    for rank in (0, 5_537, len(places) - 1):
        assert file.occurrence(7, rank) == places[rank]
    with pytest.raises(IndexError):
        file.occurrence(7, len(places))


@pytest.mark.parametrize("shard_tokens", [1, 5_000, 1 << 20])
def test_files_round_trip(spark, documents, texts, shard_tokens):
    path = scratch_path(spark, "files")
    write_files(documents, path, VOCABULARIES[0], 2, shard_tokens=shard_tokens)
    at = 0
    for row in read_files(spark, path).orderBy("doc_id").collect():
        ids = [*ids_of(VOCABULARIES[0], texts[row.doc_id]), 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_lookups_over_all_files(spark, documents, texts):
    path = scratch_path(spark, "looked-up")
    write_files(documents, path, VOCABULARIES[0], 2, shard_tokens=20_000)
    assert spark.read.parquet(path).count() > 3
    ids = {d: [*ids_of(VOCABULARIES[0], t), 2] for d, t in texts.items()}
    by_count = Counter(token for own in ids.values() for token in own)
    asked = [2, *[t for t, _ in by_count.most_common(5)], *[t for t, n in by_count.items() if n == 1][:3], 60_000, 1 << 20]
    got = {r.token: r.n for r in count_tokens(spark, path, asked).collect()}
    assert got == {token: by_count[token] for token in asked}
    assert count_tokens(spark, path, []).collect() == []
    middling = next(t for t, n in by_count.items() if 20 < n < 60)
    for token in (2, middling, 1 << 20):
        want = sorted((d, i) for d, own in ids.items() for i, x in enumerate(own) if x == token)
        assert sorted(tuple(r) for r in find_token(spark, path, token).collect()) == want


def test_files_of_odd_rows(spark, odd):
    path = scratch_path(spark, "files")
    write_files(odd, path, VOCABULARIES[0], 2)
    rows = read_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 1, 2, 3, 4, 5, 5, 5, 6]
    assert sorted(r.n_tokens for r in rows) == sorted(len(ids_of(VOCABULARIES[0], t)) + 1 for _, t, *_ in ODD_ROWS)
    assert [r.start for r in rows[1:]] == list(np.cumsum([r.n_tokens for r in rows])[:-1])


@given(st.integers(1, 20_000), st.sampled_from([1, 2, 7, 64, 4096]))
def test_cuts_have_class_lengths(tokens, capacity):
    classes = cuts(tokens, capacity)
    assert sum(capacity // c for c in classes) == tokens and all(1 <= c <= capacity for c in classes)
    ends = last_ends(tokens, capacity)
    assert (not ends and tokens % capacity == 0) or ends[-1] == tokens


@pytest.mark.parametrize("which", ["documents", "odd"])
@pytest.mark.parametrize("capacity", [4096, 100])
def test_packing(request, which, capacity):
    docs = request.getfixturevalue(which)
    rows = docs.collect()
    pieces = harmonic_packing(docs.repartition(5), VOCABULARIES[1], 2, capacity=capacity, with_ids=True).collect()
    sequences: dict = {}
    documents: dict = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        documents.setdefault(p.doc_id, []).append(p)
        assert p.length * 4 == len(p.ids) and zlib.crc32(p.ids) == p.ids_crc32
    assert sorted(sequences) == list(range(len(sequences)))
    padded = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padded += 0 if at & (at - 1) == 0 else capacity - at
    assert padded < 0.01 * sum(p.length for p in pieces) + capacity * (capacity & (capacity - 1) > 0)
    for doc_id, own in documents.items():
        want = sorted([*ids_of(VOCABULARIES[1], r.text), 2] for r in rows if r.doc_id == doc_id)
        if len(want) == 1:
            got = b"".join(p.ids for p in sorted(own, key=lambda p: p.start))
            assert got == np.array(want[0], "<u4").tobytes() and {p.doc_tokens for p in own} == {len(want[0])}
        assert sum(p.length for p in own) == sum(map(len, want))
    assert {r.doc_id for r in rows} == set(documents)
