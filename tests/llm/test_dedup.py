from __future__ import annotations

import random

import numpy as np
import pytest
from brute import near_duplicates as brute_near
from brute import near_vectors as brute_vectors
from brute import substring_dedup as brute_cut
from pyspark.sql import functions as F

from jobloom.llm import embedding_dedup, minhash_dedup, substring_dedup
from jobloom.llm.bitmap import Bitmap
from jobloom.llm.cluster import Scratch
from jobloom.llm.components import connected_components
from jobloom.llm.embedding_dedup import near_vectors
from jobloom.llm.minhash_dedup import near_duplicates
from jobloom.llm.substring_dedup import COVERS, cover_for, dedup_substrings


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ä", "b", "Cc", "dd", "e!", "ff", "Gg"]) + rng.choice("xyzXYZ0123456789")
    base = [[word() for _ in range(rng.choice([0, 1, 3, 12, 13, 40, 120]))] for _ in range(12)]
    docs = {}
    for i in range(n):
        w = list(rng.choice(base))
        if w and rng.random() < 0.6:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w[rng.randrange(5) :] + list(rng.choice(base))[:30]
        docs[i] = rng.choice([" ", "\n", " \t "]).join(w)
    return docs | {n: None, n + 1: "", n + 2: " \n ", n + 3: "one two", n + 4: "ONE  two", n + 5: "\x1c a b"}


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], "doc_id long, text string, n_words string, id int")


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_near_duplicates(spark, seed, size):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs), size).collect()}
    assert got == brute_near(docs, size, 80)


def test_chain_of_near_duplicates(spark):
    """A family in which the ends of a chain are unlike: only steps between neighbours link it."""
    words = [f"w{i}" for i in range(400)]
    docs = {i: " ".join(words[i * 3 : i * 3 + 60]) for i in random.Random(5).sample(range(100), 100)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs), 4).collect()}
    assert got == brute_near(docs, 4, 80)
    assert len({c for _, c in got.values()}) == 1


def test_later_comparison_finds_what_stars_miss(spark, monkeypatch):
    """Without any star pair the comparison across components alone finds every link."""
    monkeypatch.setattr(minhash_dedup, "_alike", lambda pairs, *_: pairs.where("false").select("a", "b"))
    docs = corpus(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs), 4).collect()}
    assert got == brute_near(docs, 4, 80)


def test_large_buckets_are_cut(spark, monkeypatch):
    """Blocks of two comparisons find the same links, when stars find none and when they find most."""
    monkeypatch.setattr(minhash_dedup, "_PAIRS", 2)
    docs = corpus(7)
    want = brute_near(docs, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs), 4).collect()} == want
    monkeypatch.setattr(minhash_dedup, "_alike", lambda pairs, *_: pairs.where("false").select("a", "b"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, docs), 4).collect()} == want


def test_near_duplicates_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_duplicates(rows, 4).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(rows.limit(0), 4).collect() == []


def test_collisions_of_long_texts(spark):
    """Shingles that 32 bits make alike don't refute a pair, however many they are."""
    long = " ".join(f"w{i}" for i in range(200_000))
    r = minhash_dedup._members(spark.createDataFrame([(1, long), (2, ""), (3, "a b a b")], "id long, text string"), 1).orderBy("id").collect()
    assert [x.alike for x in r] == [len(x.grams) - len(set(x.grams)) for x in r] and r[0].alike > 0 and [x.id for x in r] == [1, 3]
    row = [[0] * minhash_dedup._PACKED, [5] * minhash_dedup.BANDS]
    # 20 shingles each, all common, eight of which are alike to others
    members = spark.createDataFrame([(i, *row, [*range(12), *[0] * 8], 8) for i in (1, 2)], "id long, packed array<long>, keys array<long>, grams array<int>, alike int")
    placed = spark.createDataFrame([(5, 1, 20, 1), (5, 2, 20, 2)], "band long, id long, n long, component long")
    assert [tuple(x) for x in minhash_dedup._across(placed, members, 80, Scratch(spark)).collect()] == [(1, 2)]


def test_covers():
    for period, cover in COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert [cover_for(w)[::2] for w in (5, 8, 13, 50)] == [(1, 5), (1, 8), (7, 7), (31, 20)]


@pytest.mark.parametrize(("seed", "window"), [(1, 13), (2, 5), (3, 50)])
def test_substrings(spark, seed, window):
    docs = corpus(seed)
    out = dedup_substrings(frame(spark, docs), window).collect()
    want = brute_cut(docs, window)
    assert {r.doc_id: (r.n_words, r.n_removed, (r.text or "").split()) for r in out if r.doc_id != 65} == {i: v for i, v in want.items() if i != 65}
    assert all(r.text == docs[r.doc_id] for r in out if r.n_removed == 0) and {r.id for r in out} == {1}


def test_substrings_when_the_map_is_full(spark, monkeypatch):
    """Every bit set: false bits cost windows, not results."""
    monkeypatch.setattr(substring_dedup, "_shared_map", lambda *_: Bitmap(np.full(1 << 22, 2**64 - 1, dtype=np.uint64), 28))
    docs = corpus(6)
    got = {r.doc_id: r.n_removed for r in dedup_substrings(frame(spark, docs), 13).collect()}
    assert got == {i: v[1] for i, v in brute_cut(docs, 13).items()}


def test_substrings_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    rows = spark.createDataFrame([(None, long), (5, long), (5, long), (7, f"start {long}\nend "), (8, f"{long} ")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, len(r.text.split())) for r in dedup_substrings(rows, 13).collect())
    assert got == [(0, 0, 5000), (5, 0, 5000), (5, 0, 5000), (7, 5000, 2), (8, 5000, 0)]
    assert dedup_substrings(rows.limit(0), 13).collect() == []


def test_bitmap(spark):
    """It holds all hashes given, and few others; nulls are left out."""
    given = np.random.default_rng(3).integers(-(2**63), 2**63, 3000)
    rows = spark.createDataFrame([(int(h),) for h in given] + [(None,), (int(given[0]),)], "h long")
    some = Bitmap.of(rows, "h", 20, Scratch(spark))
    assert some.holds(given.view(np.uint64)).all() and some.holds((given + 10**15).view(np.uint64)).mean() < 0.01
    assert not Bitmap.of(rows.limit(0), "h", 8, Scratch(spark)).holds(given.view(np.uint64)).any()


def test_components(spark):
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(40)]
    edges = rng.sample(chain, 40) + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    want = {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_vectors(spark):
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(20)]
    rows = []
    for i in range(150):
        v = [x + rng.gauss(0, 0.2) for x in rng.choice(base)] if rng.random() < 0.8 else list(rng.choice(base))
        rows.append((i, v, rng.choice([0, 0, 1])))
    rows += [(200, None, 0), (201, [0.0] * 64, 0), (202, base[0], None), (203, [None] + base[0][1:], 0), (204, [float("nan")] + base[0][1:], 0), (205, [float("inf")] + base[0][1:], 0), (206, [], 0), (207, base[0], 0), (208, base[0], 0), (209, [2 * x for x in base[0]], 0), (210, [1.0], 0)]
    rows += [(300 + i, v, 0) for i, v in enumerate([[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [2.0, 4.0, 6.0], [3.0, -2.0, 1.0], [1.0, 0.0], [1.0, 0.1], [1e200, 1e200], [1e200, 1.1e200], [1e-200, 1e-200]])]
    out = near_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, id string"), 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    want = {i: x for n in (64, 3, 2, 1) for i, x in brute_vectors([(i, [y / max(map(abs, v)) for y in v] if n < 64 else v, lab) for i, v, lab in rows if i != 204 and v is not None and len(v) == n], 0.93).items()}
    assert all(got[i] == want[i] for i in range(300, 309)) and got[306] == (2, 306)
    found, there = sum(got[i][0] for i in want), sum(n for n, _ in want.values())
    assert found >= 0.97 * there and all(got[i][0] <= want[i][0] for i in want)
    assert all(got[i] == (0, i) for i in (200, 201, 202, 203, 204, 205, 206, 210))
    assert out.where("vec_id = 207").first().n_links == want[207][0]


def test_vectors_at_the_threshold(spark):
    """A cosine of exactly the threshold links; one below it by the least step doesn't."""
    rows = [(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1), (3, [3.0, 4.0], 1)]
    out = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.8).collect()}
    assert out == {1: 0, 2: 1, 3: 1}


def test_wider_keys(spark, monkeypatch):
    """Keys as for some million vectors in a group take more rotations and keep the recall."""
    plan = embedding_dedup.Plan.of(1 << 22, 0.93)
    assert (plan.width, plan.per_rotation) == (23, 2) and plan.rotations == -(-plan.tables // 2) and embedding_dedup.Plan.of(2000, 0.93) == embedding_dedup.Plan(16, 8)
    monkeypatch.setattr(embedding_dedup, "LEAST_WIDTH", 23)
    rng = random.Random(11)
    base = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in rng.choice(base)], 0) for i in range(250)]
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute_vectors(rows, 0.93)
    assert sum(got.values()) >= 0.95 * sum(n for n, _ in want.values()) > 0 and all(got[i] <= want[i][0] for i in want)


def test_vectors_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert near_vectors(spark.createDataFrame([], schema)).collect() == []
    got = near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.01], 1)], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (2, 1, 2, True), (2, 1, 2, True), (3, 1, 2, False)]
    assert near_vectors(spark.createDataFrame([(1, None, None)], schema)).first().kept
