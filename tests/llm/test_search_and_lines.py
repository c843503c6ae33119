import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from starloom.llm import best_position, line_runs
from starloom.llm.best_position import Shard, lexical_search
from starloom.llm.bisection import Buckets, bucket_gains, cutoff, feature_buckets, target_resample
from starloom.llm.common import read_table
from starloom.llm.line_runs import LineRuns, dedup_lines
from starloom.llm.words import word_lists
from starloom.scratch import scratch_path
from tests.conftest import SMALL
from tests.llm.conftest import ODD_ROWS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


@given(st.text(), st.integers(1, 9))
def test_words_are_never_cut(text, piece):
    got = [w.decode() for words in word_lists(text.encode("utf-8", "replace"), piece) for w in words]
    assert got == terms_of(text.encode("utf-8", "replace").decode())


# Ranked search


def plain_search(docs, items, k):
    """(item, rank, id, score) by scoring every document; ``docs`` are (id, text), ``items`` (id, text)."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, c.total()) for i, c in counted if c]
    n, length = len(counted), sum(size for _, _, size in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for own, c, size in counted:
            m = 100 - 25 + (25 * size * n) // length
            score = 0
            for term in terms_of(text):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1)))
                score += w * ((1000000000 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scores.append((-score, own is None, own or 0, own))
        out += [(item, rank, own, -score) for rank, (score, _, _, own) in enumerate(sorted(scores)[:k], 1)]
    return out


def found_rows(df):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()]


@pytest.mark.parametrize("cells, terms_at_once", [(1 << 22, 1 << 12), (2000, 60)])
def test_search_matches_brute_force(spark, documents, texts, cells, terms_at_once):
    items = read_table(spark, SMALL, "benchmark").limit(12)
    want = plain_search(texts.items(), [tuple(r) for r in items.select("item_id", "text").collect()], 20)
    got = lexical_search(documents.repartition(3), items, cells=cells, terms_at_once=terms_at_once)
    assert sorted(found_rows(got)) == sorted(want)


def test_search_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [(1, "the same row TWICE and wörd mark"), (2, None), (3, ""), (4, "nowhere123"), (None, "text id here"), (1, "text"), (1, "text")],
        "item_id int, text string",
    ).withColumns({"ID": F.lit(1), "score": F.lit(2)})
    clashing = odd.withColumns({c: F.lit(0) for c in ("item", "tie", "rank", "score", "n", "terms")})
    got = lexical_search(clashing, items, k=3).collect()
    docs = [(r[0], r[1]) for r in ODD_ROWS]
    want = [x for item in [(1, "the same row TWICE and wörd mark"), (None, "text id here"), (1, "text")] for x in plain_search(docs, [item], 3)]
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == Counter(want)
    assert lexical_search(nothing, items).collect() == [] and lexical_search(odd, items.limit(0)).collect() == []


def test_ties_go_to_the_smaller_id_across_tasks(spark):
    docs = spark.createDataFrame([(i if i % 50 else None, f"alpha beta {'gamma' * (i % 2)}") for i in range(400)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha"), (2, "gamma alpha")], "item_id int, text string")
    rows = found_rows(lexical_search(docs.repartition(7), items, k=30, cells=40))
    want = plain_search([tuple(r) for r in docs.collect()], [(1, "alpha"), (2, "gamma alpha")], 30)
    assert sorted(rows) == sorted(want)


@given(st.integers(0, 2**32), st.integers(1, 6), st.integers(0, 30))
def test_a_shard_gives_all_that_reach_the_kth_score(seed, k, least):
    random = np.random.default_rng(seed)
    size, terms = 300, 4
    impacts = random.integers(0, 12, (terms, size)) * (random.random((terms, size)) < 0.4)
    term, doc = np.nonzero(impacts)
    shard = Shard(size, terms, term, doc, impacts[term, doc])
    own, times = np.array([0, 2, 3]), np.array([1, 2, 1])
    scores = (impacts[own] * times[:, None]).sum(axis=0)
    docs, got = shard.search(own, times, k, least)
    kth = max(least, 1, np.sort(scores)[-k])
    assert sorted(docs.tolist()) == np.flatnonzero(scores >= kth).tolist() and (scores[docs] == got).all()


def test_reading_stops_long_before_the_lists_end(monkeypatch):
    size = 20_000
    impact = np.concatenate([np.arange(size, 0, -1), np.arange(size, 0, -1)])
    shard = Shard(size, 2, np.repeat([0, 1], size), np.tile(np.arange(size), 2), impact)
    read = []
    unique = np.unique
    monkeypatch.setattr(best_position.np, "unique", lambda x: read.append(len(x)) or unique(x))
    docs, _ = shard.search(np.array([0, 1]), np.array([1, 1]), 5, 0)
    assert docs.tolist() == [0, 1, 2, 3, 4] and sum(read) <= 100


# Resampling to a target


def plain_resample(docs, target, percent=10, least=20, longest=1):
    """Per (id, text): words, features, weight, score, and the ranks by (score, id, text's hash)."""

    def features(text):
        words = terms_of(text)
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % 10000

    raw, wanted = (Counter(bucket(f) for t in texts for f in features(t)[1]) for texts in ([t for _, t in docs], target))
    s_all, t_all = raw.total(), wanted.total()
    out = []
    for own, text in docs:
        words, fs = features(text)
        gains = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in map(bucket, fs)]
        h = int(hashlib.sha256(f"2024:{own}".encode()).hexdigest()[:8], 16)
        out.append([own, len(words), len(fs), sum(gains), sum(gains) + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out))


@pytest.mark.parametrize("percent, least, longest", [(10, 20, 1), (37, 5, 3), (100, 1, 1)])
def test_resampling_matches_brute_force(spark, documents, texts, percent, least, longest):
    target = read_table(spark, SMALL, "benchmark")
    want = plain_resample(list(texts.items()), [r.text for r in target.collect()], percent, least, longest)
    got = target_resample(documents.repartition(3), target, percent, least, longest).collect()
    assert sorted((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got) == want


def test_runs_of_words_over_part_borders(monkeypatch):
    text = ("one two  three, four " * 50).encode()
    whole = np.concatenate([own for _, own in feature_buckets(text, Buckets(997), 3)])
    monkeypatch.setattr("starloom.llm.bisection.word_lists", lambda t: word_lists(t, 7))
    parts = [own for _, own in feature_buckets(text, Buckets(997), 3)]
    assert len(parts) > 50 and Counter(np.concatenate(parts).tolist()) == Counter(whole.tolist())


@pytest.mark.parametrize("size", [1, 2, 49, 50, 333, 999, 1000])
@pytest.mark.parametrize("sections", [2, 16])
def test_cutoff_takes_exactly_the_first_rows(spark, size, sections):
    random = np.random.default_rng(size)
    values = list(zip(random.integers(-3, 3, 1000).tolist(), random.integers(-(2**62), 2**62, 1000).tolist(), strict=True))
    rows = spark.createDataFrame(values, "a long, b long").repartition(3)
    got = rows.filter(cutoff(rows, ["a", "b"], size, sections)).collect()
    assert sorted(map(tuple, got)) == sorted(values)[:size]


def test_resampling_of_odd_rows(spark, odd, nothing):
    target = spark.createDataFrame([(None,), ("row and text",)], "text string").withColumn("TIE", F.lit(1))
    clashing = odd.withColumns({c: F.lit(0) for c in ("tie", "row", "score", "rank", "own", "falling", "before")})
    out = target_resample(clashing, target, percent=50, least_words=1).collect()
    assert len(out) == len(ODD_ROWS) and {r.n_words for r in out if r.doc_id in (1, 2, 3)} == {0}
    # A null text, an empty one and blanks have no words; of the seven others three are drawn, each of two copies by itself.
    assert sorted(r["rank"] for r in out if r["rank"]) == [1, 2, 3]
    assert target_resample(nothing, target).collect() == []
    assert all(r["rank"] is None for r in target_resample(odd, target.limit(0), percent=0).collect())
    with pytest.raises(TypeError):
        target_resample(odd.withColumn("doc_id", F.lit("x")), target)


def test_a_third_of_null_ids_and_a_third_with_one_id(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"word{i % 5} " * 30) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = target_resample(docs, spark.createDataFrame([("word1",)], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 451))
    low = min(r.score for r in out if r["rank"])
    assert all(r["rank"] or r.score <= low for r in out)


def test_gains_of_nothing():
    assert bucket_gains(np.zeros(3, np.int64), np.zeros(3, np.int64)).tolist() == [0, 0, 0]


# Line dedup


def plain_lines(docs, least_points=40, least_docs=5):
    holders = defaultdict(set)
    low = -math.inf

    def key(line):
        return line.strip(" \t\n\v\f\r").translate(LOWER)

    for own, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_points:
                holders[key(line)].add(low if own is None else own)
    out = []
    for own, text in docs:
        lines = (text or "").split("\n")
        here = low if own is None else own
        kept = [x for x in lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == here]
        out.append((own, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def kept_rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


@pytest.mark.parametrize("batches, fan_out, least", [(8, 4, 5), (5, 2, 2), (1, 4, 3)])
def test_lines_match_brute_force(spark, documents, texts, batches, fan_out, least):
    got = dedup_lines(documents.repartition(3), scratch_path(spark, "runs"), 40, least, batches, fan_out)
    want = plain_lines(texts.items(), 40, least)
    assert kept_rows(got) == want and sum(n for _, _, n, _ in want) > 0


def test_lines_of_odd_rows(spark, odd, nothing):
    long = "a line of forty letters or more, ÄÖÜ, as it is said"
    rows = [(r[0], r[1]) for r in ODD_ROWS]
    rows += [(None, long), (None, f"x\n{long}"), (50, f"{long}\n{long}\ny"), (51, f"\t {long.upper().replace('Ä', 'Ä')}\r\n"), (50, f"z\n{long}")]
    rows += [(52, " " * 60), (52, None), (53, long[:39])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit(0) for c in ("TIE", "pos", "h1", "batch", "lost", "n_lines", "keeper")})
    for least in (2, 3, 4):
        got = dedup_lines(docs, scratch_path(spark, "runs"), 40, least, batches=3, fan_out=2)
        assert kept_rows(got) == plain_lines(rows, 40, least)
    assert dedup_lines(nothing, scratch_path(spark, "runs")).collect() == []
    with pytest.raises(TypeError):
        dedup_lines(odd.withColumn("doc_id", F.lit("x")), scratch_path(spark, "runs"))


def test_a_line_in_a_third_of_all_documents(spark):
    rows = [(i, f"line of its own, number {i}, with more than forty letters" + "\nthe line that very many documents share, word by word" * (i % 3 == 0)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = kept_rows(dedup_lines(docs, scratch_path(spark, "runs")))
    assert got == plain_lines(rows) and sum(n for _, _, n, _ in got) == 999


def test_no_names_of_runs_stay_in_the_catalog(spark, documents):
    def names():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")}

    before, path = names(), scratch_path(spark, "runs")
    dedup_lines(documents, path, batches=5, fan_out=3).collect()
    assert names() == before
    with pytest.raises(ZeroDivisionError), LineRuns(spark, path) as runs:
        assert len(runs.runs) == 3 and runs.summary().count() and len(names()) == len(before) + 3
        raise ZeroDivisionError
    assert names() == before


def test_runs_are_levelled_and_can_be_reopened(spark):
    path = scratch_path(spark, "runs")
    runs, want = LineRuns(spark, path, fan_out=3), {}
    for batch in range(7):
        keys = [(k, -k, 1 + k % 3, 100 * batch + k) for k in range(batch, batch + 20)]
        for h1, h2, n, keeper in keys:
            seen = want.setdefault((h1, h2), [0, keeper])
            seen[0] += n
        runs = LineRuns(spark, path, fan_out=3) if batch % 2 else runs
        runs.add(spark.createDataFrame(keys, "h1 long, h2 long, n long, keeper long"))
    again = LineRuns(spark, path)
    assert [level for level, *_ in again.runs] == [1, 1, 0] and again.version == runs.version
    for own in (runs, again):
        assert {(r.h1, r.h2): [r.n, r.keeper] for r in own.summary().collect()} == want
    firsts = sum(spark.table(name).filter("first").count() for _, name, _, _ in again.runs)
    assert firsts == len(want)


def test_runs_are_merged_without_moving_them(spark):
    path = scratch_path(spark, "runs")
    runs = LineRuns(spark, path)
    keys = spark.range(100).selectExpr("id AS h1", "id AS h2", "1L AS n", "id AS keeper")
    runs.add(keys)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = spark.table(runs.runs[0][1]).filter("first").select("h1", "h2", F.lit(True).alias("seen"))
        plan = keys.join(seen, line_runs.KEY, "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan
