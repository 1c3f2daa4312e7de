"""Near-duplicate documents, vectors and components against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runtally.llm import components, embedding_pairs, minhash
from tests.llm.cases import awkward, empty, prose


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(9, i) for i in range(10, 40)] + [(3, 30), (2, 31), (2, 2)],
    [(random.Random(1).randrange(200), random.Random(i).randrange(200)) for i in range(150)]])
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long")
    edges = [(a, b) for a, b in edges if a != b]
    want = roots({x for e in edges for x in e}, edges)
    assert {r["node"]: r["root"] for r in components.components(df).collect()} == want


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_documents(rows, percent):
    sets = [(k, shingles(t)) for k, t in rows]
    nodes = sorted({k for k, _ in sets if k is not None})
    edges = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if a is not None and b is not None and x and 100 * len(x & y) >= percent * len(x | y)]
    return sets, roots(nodes, edges)


def edit(text, seed, n):
    rng, words = random.Random(seed), text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def copies():
    base = [prose(i, 120) for i in range(8)]
    rows = [(i, b) for i, b in enumerate(base)]
    for k in range(60):
        rows.append((100 + k, edit(base[k % 8], k, k % 4)))
    rows += [(300 + i, base[0].upper()) for i in range(30)] + [(400, "a b c"), (401, "A  b\tc"), (402, "a b d"), (403, ""), (404, None), (None, base[1])]
    rows += [(500, " ".join(base[2].split()[:7])), (501, " ".join(base[2].split()[:6]))]
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_documents(spark, percent):
    rows = copies()
    sets, want = brute_documents(rows, percent)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=str) == sorted(((k, len(s)) for k, s in sets), key=str)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_members_that_the_leader_does_not_join(spark):
    """A chain: each links with the next one only, so one leader cannot hold the group together."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[12 * i:12 * i + 220])) for i in range(12)]
    _, want = brute_documents(rows, 85)
    assert len(set(want.values())) == 1
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_group_of_many_variants_in_small_blocks(spark, monkeypatch):
    """Copies of one text on both sides of the threshold, dealt to many blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = prose(3, 150)
    rows = [(i, edit(base, i, i % 9)) for i in range(70)]
    rows += [(100 + i, edit(edit(base, 1000 + i % 3, 9), i, 1)) for i in range(20)]
    _, want = brute_documents(rows, 85)
    assert 4 < len(set(want.values())) < 80
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_blocks_against_sets(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    texts = [edit(prose(5, 120), i, i % 7) for i in range(30)] + [prose(6, 80), "a b c", ""]
    sets = minhash.shingle_sets(texts)
    regs = np.array([minhash.registers(s) for s in sets])
    got = minhash._links_of(regs[:12], regs[12:], sets[:12], sets[12:], np.ones((12, len(sets) - 12), bool), 85)
    own = [set(s.tolist()) for s in sets]
    assert got.tolist() == [[bool(b) and 100 * len(a & b) >= 85 * len(a | b) for b in own[12:]] for a in own[:12]]
    assert minhash._spanning([(b"a", b"b"), (b"b", b"a"), (b"b", b"c")], {b"a": b"a", b"b": b"b", b"c": b"a"}) == [(b"a", b"b")]


def test_sketch_estimates():
    rng = random.Random(3)
    pool = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    for share in (0.5, 0.85, 0.95):
        n = 1000
        k = round(2 * n * share / (1 + share))
        a, b = np.sort(pool[:n]), np.sort(pool[n - k:2 * n - k])
        found, used = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], np.array([n]), np.array([n]))
        assert abs(found[0] - share) < 5 * math.sqrt(share * (1 - share) / used[0])
    assert (minhash.registers(np.zeros(0, np.uint64)) == 0xFFFF).all()


def test_awkward_documents(spark):
    df = awkward(spark, "node key regs component_id band")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == df.count()
    kept = minhash.keep_first(df)
    assert kept.schema == df.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 2, 3, 4, 5, 6, 7, 8, 9, None, None], key=str)
    assert minhash.near_duplicates(empty(spark)).count() == 0 and minhash.keep_first(empty(spark)).count() == 0


def vectors():
    rng = np.random.default_rng(2)
    rows, key = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(6):
                rows.append((key, (centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.12, 0.2])).tolist(), label))
                key += 1
    rows += [(key + i, v, 0) for i, v in enumerate([None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15,
                                                    rows[0][1], [2 * x for x in rows[0][1]], [1e-30 * x for x in rows[0][1]], rows[0][1][:8]])]
    return rows


def brute_vectors(rows, cosine):
    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    edges = []
    for (a, x, p), (b, y, q) in itertools.combinations(rows, 2):
        if p is not None and p == q and fine(x) and fine(y) and len(x) == len(y):
            x, y = np.array(x), np.array(y)
            if (x / np.linalg.norm(x)) @ (y / np.linalg.norm(y)) >= cosine:
                edges.append((a, b))
    n = {k: 0 for k, _, _ in rows}
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    return n, roots(n, edges)


def test_near_vectors(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(embedding_pairs, "BLOCK", 4)
    n, comp = brute_vectors(rows, 0.98)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("node", F.lit("clash"))
    got = embedding_pairs.near_vectors(df).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == n and sum(n.values()) > 100
    assert {r["vec_id"]: r["component_id"] for r in got} == comp
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_without_key_and_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_pairs.near_vectors(df).collect()), key=str)
    assert got == [(4, 1, 4, True), (4, 1, 4, True), (None, 0, None, None)]
    assert embedding_pairs.near_vectors(df.limit(0)).count() == 0
