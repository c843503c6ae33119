import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from starloom.llm import language, pfair
from starloom.llm.common import read_table
from starloom.llm.importance import dividing_weight, importance_resample, log_ratios
from starloom.llm.language import WINDOW, Network, identify_languages, learn, windows_of
from starloom.llm.ngrams import hashed_ngrams
from starloom.llm.pfair import mix_sources, mix_to_end, phases, schedule, whole_shares
from tests.conftest import SMALL
from tests.llm.conftest import ODD_ROWS


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * WINDOW, bytes(range(1, 256)) * 5]
    windows, counts = windows_of(texts)
    assert counts.tolist() == [1, 1, 5]
    starts = np.cumsum(counts) - counts
    assert [windows[s : s + c].tobytes().rstrip(b"\0") for s, c in zip(starts, counts, strict=True)] == texts


def test_gradients_and_pair_tables():
    random = np.random.default_rng(0)
    network = Network.start(["a", "b"])  # and a class for none of them
    for p in network.parameters():
        p += random.standard_normal(p.shape).astype(np.float32) * 0.05
    windows = random.integers(0, 256, (4, WINDOW)).astype(np.uint8)
    labels = np.array([0, 1, 2, 1])

    def loss():
        network.tables = None
        return float(-np.log(network.probabilities(windows).astype(float)[np.arange(4), labels]).mean())

    for p, g in zip(network.parameters(), network._gradients(windows, labels), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, step = p[at], 2e-3
        p[at] = old + step
        high = loss()
        p[at] = old - step
        low = loss()
        p[at] = old
        assert abs((high - low) / (2 * step) - g[at]) < 0.03 * abs(g[at]) + 2e-3


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = identify_languages(docs).collect()
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]
    assert len(right) > 200 and np.mean(right) > 0.97


def test_learns_nothing_from_held_out_rows_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 1)
    rows = [(i, f"text {i} of words", "x" if zlib.crc32(str(i).encode()) % 4 == 2 else "y") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert learn(docs).languages == ["y"]
    assert {r.lang_pred for r in identify_languages(docs).collect()} == {"y"}


def test_languages_of_odd_rows(odd, nothing):
    rows = identify_languages(odd).collect()
    assert len(rows) == len(ODD_ROWS)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3, 4))
    assert {r.lang_pred for r in rows if r.doc_id in (None, 5, 6)} <= {"en", "de", "fr"}
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert identify_languages(nothing).collect() == []


def plain_tokens(data):
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z\x80-\xff0-9\x00-\x20\x7f]+", data)


@given(st.lists(st.text(st.sampled_from("aAbB 1!é\n.$"), max_size=25), min_size=1, max_size=8))
def test_ngrams_of_a_batch(texts):
    data = [t.encode() for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    bucket, text = hashed_ngrams(joined, np.cumsum([len(d) + 1 for d in data]), 1 << 40)
    assert np.bincount(text, minlength=len(texts)).tolist() == [3 * len(plain_tokens(d)) for d in data]
    for n, d in enumerate(data):  # the same n-grams as of the text alone
        own, _ = hashed_ngrams(np.frombuffer(d + b"\n", np.uint8), np.array([len(d) + 1]), 1 << 40)
        assert sorted(own) == sorted(bucket[text == n])
    singles = {}
    for n, d in enumerate(data):
        for i, (token, one) in enumerate(zip(plain_tokens(d), bucket[: len(bucket) // 3][text[: len(text) // 3] == n], strict=True)):
            if i == 0:
                assert singles.setdefault(token, one) == one
    assert len(set(singles.values())) == len(singles)


def test_importance_by_brute_force(spark, documents, texts):
    labels = read_table(spark, SMALL, "labels")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = importance_resample(documents.repartition(4), labels, buckets=512).collect()
    fits = {r.key: r.fits for r in _sample(labels).collect()}
    grams = {}
    for d, t in texts.items():
        data = np.frombuffer(t.encode() + b"\n", np.uint8)
        grams[d] = hashed_ngrams(data, np.array([len(data)]), 512)[0]
    every = np.bincount(np.concatenate(list(grams.values())), minlength=512)
    target = np.bincount(np.concatenate([g for d, g in grams.items() if quality.get(d) == 1 and fits[d]]), minlength=512)
    ratios = log_ratios(every, target)
    assert np.allclose([r.log_weight for r in rows], [ratios[grams[r.doc_id]].sum() for r in rows])
    in_order = sorted(rows, key=lambda r: -r.gumbel_weight)
    assert [r.rank for r in in_order] == list(range(len(rows)))
    weights = {r.doc_id: r.log_weight for r in rows}
    good, bad = (np.array([weights[d] for d, q in quality.items() if q == k and d in weights and not fits[d]]) for k in (1, 0))
    kept = sum(w >= dividing_weight(good, bad) for w in weights.values())
    assert [r.kept for r in in_order] == [n < kept for n in range(len(rows))]
    noise = np.array([r.gumbel_weight - r.log_weight for r in rows])
    assert abs(noise.mean() - 0.577) < 0.4 and abs(noise.std() - 1.28) < 0.4
    few = importance_resample(documents, labels, size=7, buckets=512).filter("kept").collect()
    assert {r.doc_id for r in few} == {r.doc_id for r in in_order[:7]}


def _sample(labels):
    from starloom.llm.importance import labelled_sample

    return labelled_sample(labels, "doc_id", "quality")


def test_quality_of_clean_and_junk_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = read_table(spark, folder, "labels")
    kept = {r.doc_id: r.kept for r in importance_resample(read_table(spark, folder, "documents"), labels).collect()}
    rate = {q: np.mean([kept[r.doc_id] for r in labels.filter(f"quality = {q}").collect()]) for q in (0, 1)}
    assert rate[1] > 0.98 and rate[0] < 0.1


def test_importance_of_odd_rows(spark, odd, nothing):
    ddl = "doc_id long, quality int"
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (6, 1), (None, 1), (4, None)], ddl)
    rows = importance_resample(odd, labels).collect()
    assert len(rows) == len(ODD_ROWS) and sorted(r.rank for r in rows) == list(range(len(rows)))
    assert all(r.log_weight == 0 for r in rows if r.doc_id in (1, 2, 3))
    unlabelled = importance_resample(odd, labels.limit(0)).collect()
    assert all(r.log_weight == 0 and r.kept for r in unlabelled)
    assert importance_resample(nothing, labels).collect() == []


def test_null_ids_draw_noise_of_their_own(spark):
    rows = [(None if i % 3 else i, f"text number {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = importance_resample(docs, read_table(spark, SMALL, "labels"), size=100).collect()
    assert len({r.gumbel_weight - r.log_weight for r in out if r.doc_id is None}) == 200
    assert 20 < sum(r.kept and r.doc_id is None for r in out) < 100


def test_junk_scores_low_and_prose_high(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    network, random = learn(docs), np.random.default_rng(3)

    def drawn(letters, n=300):
        letters = list(letters)
        return ["".join(random.choice(letters, 1500)).encode() for _ in range(n)]

    junk = {
        "letters": drawn("abcdefghijklmnopqrstuvwxyz "), "cjk": drawn(map(chr, range(0x4E00, 0x5200))),
        "cyrillic": drawn([*map(chr, range(0x430, 0x450)), " "]), "greek": drawn([*map(chr, range(0x3B1, 0x3CA)), " "]),
        "base64": drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    }
    for name, texts in junk.items():
        assert np.mean(network.predict(texts)[1] < corpus_pipeline.LEAST_SCORE) > 0.9, (name, network.predict(texts)[1][:9])
    prose = [r.text.encode() for r in docs.filter(language.held_out("doc_id") & (F.length("text") > 300)).collect()]
    assert np.mean(network.predict(prose)[1] >= corpus_pipeline.LEAST_SCORE) > 0.99


def whole_mix(weights, blocks, period):
    """All slots of the phases: slot -> (source, block, phase); every block has been between its release and its deadline."""
    mix = {}
    for spans, slots in phases(weights, blocks, period):
        places = {(s, nth): slot for _, s, nth, slot in slots}
        for phase, s, low, high, share, first, length in spans:
            for own in range(high - low):
                at = own // share * length + places[s, own % share]
                # Within these dates a source is within less than one block of its share at every slot.
                assert own * length // share <= at < -(-(own + 1) * length // share)
                assert mix.setdefault(first + at, (s, low + own, phase)) == (s, low + own, phase)
    assert sorted(mix) == list(range(sum(blocks.values())))
    assert sorted((s, b) for s, b, _ in mix.values()) == sorted((s, b) for s, n in blocks.items() for b in range(n))
    return mix


@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=3), st.tuples(st.floats(1e-2, 1e2), st.integers(1, 200)), min_size=1, max_size=9))
def test_phases_give_every_block_a_slot_and_keep_the_rescaled_weights(sources):
    weights, blocks = ({s: v[i] for s, v in sources.items()} for i in (0, 1))
    mix = whole_mix(weights, blocks, 40)
    left, last = Counter(blocks), None
    for at in sorted(mix):
        s, b, p = mix[at]
        if p != last:
            shares, done, last = whole_shares({x: weights[x] for x in weights if left[x]}, 40), Counter(), p
        done[s] += 1
        left[s] -= 1
        total, length = sum(done.values()), sum(shares.values())
        assert all(abs(done[x] * length - total * n) < length for x, n in shares.items())


@pytest.mark.parametrize("sources, most", [(400, 1000), (2000, 60)])
def test_many_sources_keep_their_dates_to_the_end(sources, most):
    random = np.random.default_rng(sources)
    blocks = {f"s{i}": int(n) for i, n in enumerate(random.integers(1, most, sources))}
    whole_mix({s: n**0.5 for s, n in blocks.items()}, blocks, 1000)


def test_more_sources_than_entries(spark):
    """20,000 sources: small ones share entries, in which each has its weight's worth to within less than one block."""
    rows = [(i, "x" * (40 + i * 37 % 200), f"s{i % 19_990}" if i % 3 else "large") for i in range(60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = mix_to_end(docs, block_bytes=64, most=100).collect()
    assert len(out) == len(rows) and all(r.slot is not None for r in out)
    held = Counter()
    for _, text, source in rows:
        held[source] += len(text) + 1
    blocks = {s: -(-n // 64) for s, n in held.items()}
    slots = {(r.source, r.block): r.slot for r in out}
    assert len(set(slots.values())) == len(slots) and max(slots.values()) < sum(blocks.values())
    grouped, found, wanted = pfair._scheduled(docs, None, 2.0, 64, ("doc_id", "text", "source"), 100)
    assert len(found) == len(wanted) == 100 and sum(found.values()) == sum(blocks.values())
    entry = {(r.source, r.block): (r.entry, r.nth_of_entry) for r in grouped.collect()}
    group = min(e for e, _ in entry.values() if e.startswith("\0"))
    inside = sorted((nth, s, b) for (s, b), (e, nth) in entry.items() if e == group)
    weight = {s: held[s] ** 0.5 for s in {s for _, s, _ in inside}}
    dates = [(b + 1) / weight[s] for _, s, b in inside]
    assert len(weight) > 200 and dates == sorted(dates)
    # Slots of an entry follow the order inside it.
    assert [slots[s, b] for _, s, b in inside] == sorted(slots[s, b] for _, s, b in inside)


def test_few_entries_and_odd_rows(odd, nothing):
    for mix in (mix_sources, mix_to_end):
        rows = mix(odd, block_bytes=64, most=2).collect()
        assert len(rows) == len(ODD_ROWS) and all(r.slot is not None for r in rows)
        some = mix(odd, {"a": 1, "b": 2, None: 0}, block_bytes=64, most=1).collect()
        assert {r.source for r in some if r.slot is not None} == {"a", "b"}
        assert mix(nothing, most=1).collect() == []


def test_mix_goes_on_after_a_source_is_out(documents, texts):
    held = Counter()
    for r in documents.collect():
        held[r.source] += len(texts[r.doc_id].encode()) + 1
    weights = {s: 1 + i for i, s in enumerate(sorted(held))}
    cut = {r.doc_id: r for r in mix_sources(documents, weights, block_bytes=2000).collect()}
    rows = mix_to_end(documents.repartition(5), weights, block_bytes=2000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(r.slot is not None for r in rows)
    assert all(r.slot == cut[r.doc_id].slot for r in rows if cut[r.doc_id].in_mix)
    horizon = max(r.slot for r in cut.values() if r.in_mix)
    assert all(r.slot > horizon or cut[r.doc_id].in_mix for r in rows) and len(cut) > sum(r.in_mix for r in cut.values())
    assert len({(r.source, r.block) for r in rows}) == len({r.slot for r in rows})
    assert max(r.slot for r in rows) < sum(-(-n // 2000) for n in held.values())


def test_whole_mix_of_odd_rows(odd, nothing):
    rows = mix_to_end(odd, block_bytes=64).collect()
    assert len(rows) == len(ODD_ROWS) and all(r.slot is not None for r in rows)
    assert {r.source for r in mix_to_end(odd, {"a": 1}, block_bytes=64).collect() if r.slot is not None} == {"a"}
    assert mix_to_end(nothing).collect() == []
