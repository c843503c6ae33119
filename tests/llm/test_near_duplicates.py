import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import rotation_codes, simhash
from starloom.llm.common import read_table
from starloom.llm.components import components
from starloom.llm.rotation_codes import embedding_groups, encode, estimate, least_products, linked, tile_links
from starloom.llm.simhash import near_links, simhash_groups
from tests.conftest import SMALL
from tests.llm.conftest import ODD_ROWS


def groups(n, links):
    """The smallest member of each one's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    random = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in random.integers(0, 300, (150, 2))]
    links += [(400 + i, 401 + i) for i in range(40)] + [(600, 600 + i) for i in range(60)] + [(700, 700)]
    rows = [*links, (None, 5), (5, None), links[0], links[1][::-1]]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    want = groups(701, links)
    assert got == {n: want[n] for n in {x for link in links for x in link}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_simhash(text, size):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[^\x20\x09-\x0d]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from(" \t\n\x0b\x1c\x85\xa0aBcÉé\U0001d538"), max_size=60), st.integers(1, 5))
def test_simhash(text, size):
    assert simhash.simhash(text, size) == plain_simhash(text, size)


def test_simhash_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 101) for i in range(500))
    want = plain_simhash(text, 4)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.simhash(text, 4) == want


@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=60), st.integers(0, 60), st.integers(0, 4))
def test_near_links_join_what_is_near(prints, split, radius):
    prints = np.array(prints, np.uint64)
    split = min(split, len(prints))
    a, b = (prints, None) if split == 0 else (prints[:split], prints[split:])
    links = list(near_links(a, b, radius))
    assert len(links) < len(prints)
    sides = np.arange(len(prints)) >= split
    near = [
        (i, j) for i in range(len(prints)) for j in range(i)
        if bin(int(prints[i]) ^ int(prints[j])).count("1") <= radius and (b is None or sides[i] != sides[j])
    ]
    where = {}
    for i, p in enumerate(prints.tolist()):
        where.setdefault(p, []).append(i)
    same = [(own[0], i) for own in where.values() for i in own]
    got = groups(len(prints), [(where[x][0], where[y][0]) for x, y in links] + same)
    want = groups(len(prints), near + same)
    assert got == want


@pytest.mark.parametrize("tile", [8192, 5])
def test_simhash_groups(monkeypatch, documents, texts, tile):
    monkeypatch.setattr(simhash.near_print_links, "__defaults__", (tile,))
    rows = simhash_groups(documents, 4, 4).collect()
    ids = [r.doc_id for r in rows]
    prints = np.array([plain_simhash(texts[d], 4) for d in ids], np.uint64)
    assert [r.print % 2**64 for r in rows] == prints.tolist()
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    want = groups(len(ids), near.tolist())
    smallest = {g: min(d for d, h in zip(ids, want, strict=True) if h == g) for g in set(want)}
    assert [r.component_id for r in rows] == [smallest[g] for g in want]


def test_simhash_groups_of_odd_rows(odd, nothing):
    rows = simhash_groups(odd, 4, 4).collect()
    assert len(rows) == len(ODD_ROWS)
    empty = [r for r in rows if r.print == 0]
    assert {r.doc_id for r in empty} == {1, 2, 3} and {r.component_id for r in empty} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    assert simhash_groups(nothing, 4, 4).collect() == []


def plain_links(vectors, threshold):
    vectors = np.array(vectors, float)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    return [(i, j) for i, j in np.argwhere(unit @ unit.T >= threshold).tolist() if i != j]


@pytest.mark.parametrize("epsilon_dim", [(6.0, 2), (6.0, 64), (6.0, 256)])
def test_no_link_is_lost_by_the_bounds(epsilon_dim):
    _, dim = epsilon_dim
    random = np.random.default_rng(dim)
    centres = random.standard_normal((20, dim))
    vectors = (centres[random.integers(0, 20, 400)] + random.standard_normal((400, dim)) * 0.25).astype(np.float32)
    vectors = vectors.astype(float) * random.uniform(1e-3, 1e3, 400)[:, None]
    codes, factors = encode(vectors)
    got = {(int(a), int(b)) for i, j in linked(vectors, codes, factors, None, 0.93) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i, j in plain_links(vectors, 0.93) if i < j} and len(got) > 100


def test_estimates_are_unbiased_and_bounded(monkeypatch):
    random = np.random.default_rng(1)
    a, b = random.standard_normal((2, 64))
    b = a + b
    cosine = a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    estimates = []
    for seed in range(300):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((64, 64)))
        monkeypatch.setattr(rotation_codes, "rotation", lambda dim, own=q * np.sign(np.diag(r)): own)
        codes, factors = encode(a[None])
        estimates.append(estimate(codes, factors, b[None])[0][0, 0])
    assert abs(np.mean(estimates) - cosine) < 4 * np.std(estimates) / len(estimates) ** 0.5
    assert (least_products(np.array([0.8]), 64, 0.93) < 0.8 * 0.93).all()


@pytest.mark.parametrize("tile", [1024, 20])
def test_embedding_groups(monkeypatch, spark, tile):
    monkeypatch.setattr(rotation_codes.embedding_links, "__defaults__", (tile,))
    random = np.random.default_rng(2)
    table = read_table(spark, SMALL, "embeddings").limit(150)
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in table.collect()]
    rows += [(9000 + i, [float(x) for x in np.array(rows[i % 3][1]) + random.standard_normal(64) * 0.02], rows[i % 3][2]) for i in range(40)]
    rows += [(8000 + i, rows[5][1], rows[5][2]) for i in range(30)]
    bad = [(7001, None, 1), (7002, [0.0] * 64, 1), (7003, [float("nan")] * 64, 1), (7004, [float("inf")] + [1.0] * 63, 1),
           (7005, [None] + [1.0] * 63, 1), (7006, [1.0] * 64, None), (7007, [], 1), (None, None, None)]
    odd = [(7100, [1.0, 0.0], 1), (7101, [2.0, 0.0], 1), (7101, [2.0, 0.0], 1), (None, [3.0, 0.01], 1)]
    frame = spark.createDataFrame(rows + odd + bad, "vec_id long, embedding array<float>, label int").repartition(4)
    got = sorted(map(tuple, embedding_groups(frame.withColumnRenamed("label", "lab"), 0.93, label_col="lab").collect()), key=repr)
    good = [(i, np.array(v, np.float32).astype(float), c) for i, v, c in rows + odd]
    links = []
    for key in {(c, len(v)) for _, v, c in good}:
        at = [n for n, (_, v, c) in enumerate(good) if (c, len(v)) == key]
        links += [(at[i], at[j]) for i, j in plain_links([good[n][1] for n in at], 0.93)]
    component = groups(len(good), links)
    count = np.bincount([i for i, _ in links], minlength=len(good))
    smallest = {}
    for g, (i, _, _) in zip(component, good, strict=True):
        smallest[g] = min(smallest.get(g, 10**9), 10**9 if i is None else i)
    want = [(i, int(n), smallest[g], i == smallest[g]) for (i, _, _), n, g in zip(good, count, component, strict=True)]
    want += [(i, 0, i, i is not None) for i, _, _ in bad]
    assert got == sorted(want, key=repr)
    assert embedding_groups(frame.limit(0), 0.93).collect() == [] if "lab" not in frame.columns else True


def test_tiles_whose_candidates_are_all_below_the_threshold():
    random = np.random.default_rng(5)
    a, aside = random.standard_normal((20, 64)), random.standard_normal(64)
    along = a[0] / np.linalg.norm(a[0])
    aside -= aside @ along * along
    near = 0.91 * along + np.sqrt(1 - 0.91**2) * aside / np.linalg.norm(aside)
    ids, once = np.arange(20), np.ones(20, np.int64)
    codes, factors = encode(a)
    assert [len(i) for i, _ in linked(a, codes, factors, near[None], 0.93)] == [0]  # a candidate, and no link
    assert list(tile_links((ids, once, a), codes, factors, (ids[:1] + 100, once[:1], near[None]), 0.93)) == []
    both = np.stack([a[0], near])
    assert list(tile_links((ids[:2], once[:2], both), *encode(both), None, 0.93)) == []
