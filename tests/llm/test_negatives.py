"""Hard negatives against all inner products; the tree's bounds against the vectors below it."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from runtally.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, leaf int, score int"
ANCHOR = "vec_id % 10 = 0"


def brute(rows, positives=5, negatives=10):
    ok = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
          if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v in ok:
        if i % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in ok if j != i and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA).repartition(3)
    got = hn.mine(df, F.expr(ANCHOR), **kw).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r) for r in got.collect())


def vectors(seed, n, dim=12, labels=4):
    """Clusters, repeated vectors and ties; components are multiples of 1/256, so that all arithmetic is exact."""
    rng = random.Random(seed)
    centers = [[rng.randrange(-150, 150) for _ in range(dim)] for _ in range(8)]
    rows = []
    for i in range(n):
        c = rng.choice(centers)
        v = c if rng.random() < 0.15 else [x + rng.randrange(-60, 60) for x in c]
        rows.append((i, [x / 256 for x in v], rng.randrange(labels)))
    return rows


def test_mine_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hn, "PART", 64)
    rows = vectors(1, 700)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=3) == brute(rows, 2, 3)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60, 3, 2) + [(100, None, 1), (110, [0.5, None, 0.1], 1), (120, [nan, 0.5, 0.5], 1), (130, [inf, 0.1, 0.1], 0), (140, [0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5], 1),
                                   (150, [0.0, 0.0, 0.0], 1), (160, [0.25, 0.5], 0), (161, [0.25, 0.5], 0), (162, [0.125, 0.25], 1), (170, [], 0), (171, [], 0), (172, [], 1), (180, [-1.0, -1.0, -1.0], 0)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1)]) == []


def test_repeated_keys(spark):
    rows = [(10, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [1.0, 0.0], 0), (11, [1.0, 0.0], 0), (12, [0.5, 0.0], 1), (12, [0.5, 0.0], 1)]
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)
    got = sorted(tuple(r) for r in hn.mine(df, F.expr(ANCHOR)).select("anchor_id", "positive_id", "rank", "negative_id").collect())
    assert got == sorted([(10, 11, k, 12) for k in (1, 2)] * 2)


def test_hot_vector(spark, monkeypatch):
    """A third of all rows hold one vector; it is searched in parts."""
    monkeypatch.setattr(hn, "PART", 50)
    rows = vectors(3, 400) + [(i, [0.5] * 12, i % 3) for i in range(400, 600)]
    assert mined(spark, rows) == brute(rows)


def test_bounds_hold_and_rule_out(spark):
    rows = vectors(4, 3000, 8, 3)
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)
    usable = hn._usable(df, "vec_id", "embedding", "label")
    trees = hn.fit(usable)
    trees = hn.measure(hn.placed(usable, trees), trees)
    tree, x = trees[8], np.array([v for _, v, _ in rows]) * 256
    leaf = tree.place(x)
    assert np.bincount(leaf, minlength=tree.leaves).tolist() == tree.sizes.tolist() and tree.leaves > 20
    scores = x[::100] @ x.T
    ruled = 0
    for low, high in ((100_000, 200_000), (50_000, 60_000), (-10_000, 0)):
        alive = tree.surviving(x[::100], np.full(30, float(low)), np.full(30, float(high)))
        q, r = np.nonzero((scores >= low) & (scores <= high))
        assert alive[q, leaf[r]].all()
        ruled += (~alive).sum()
    assert ruled > 0.2 * 3 * 30 * tree.leaves
