"""Suffix sorting against Python's sort; removed passages against every string of every document."""

from __future__ import annotations

import hashlib
import random

import numpy as np
from hypothesis import given, settings, strategies as st

from runtally.llm import suffix_dedup as sd
from tests.llm.cases import awkward, empty, prose

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows, length=sd.LENGTH):
    """The report of (doc_id, text) rows, from a dictionary of all strings."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, int] = {}
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - length + 1):
                s = b[i:i + length]
                least[s] = min(least.get(s, d), d)
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i:i + length]] < d:
                    gone[i:i + length] = True
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def report(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r[c] for c in COLUMNS) for r in sd.report(df).collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=200), st.lists(st.sampled_from([b"a", b"ab", b"ba", b"aab", b"\0", b"\xff", b"z" * 9]), max_size=80).map(b"".join)), st.sampled_from([8, 16, 20, 50]))
def test_two_stage_sorts_suffixes(data, depth):
    buf = sd.buffer([data])
    order = sd.two_stage(buf, len(data), depth)
    assert sorted(order.tolist()) == list(range(len(data)))
    heads = [data[i:i + depth].ljust(depth, b"\0") for i in order]
    assert heads == sorted(heads)
    prefix = sd.common_prefixes(buf, order, depth)
    padded = data + bytes(sd.PAD)
    for k in range(1, len(order)):
        x, y = (padded[i:i + depth] for i in order[k - 1:k + 1])
        assert prefix[k] == next((i for i in range(depth) if x[i] != y[i]), depth)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["abc def ", "x" * 30, "one long passage that is used again and again ", "q", "\n", "é" * 7]), max_size=12).map("".join), max_size=6))
def test_equal_strings_share_an_anchor(texts):
    raw = [t.encode() for t in texts]
    buf, place, count, anchor, doc = sd.segments(raw)
    key: dict[bytes, int] = {}
    seen = 0
    for p, n, a in zip(place.tolist(), count.tolist(), anchor.tolist()):
        assert 1 <= n <= sd.RUN
        for i in range(p, p + n):
            seen += 1
            assert key.setdefault(bytes(buf[i:i + sd.LENGTH]), a) == a
    assert seen == sum(max(0, len(r) - sd.LENGTH + 1) for r in raw)


def passages(seed, n):
    """Documents of shared and own passages, cut at odd places, with copies, repeats of ids and text of one sign."""
    rng = random.Random(seed)
    pool = [prose(i, 30) for i in range(12)] + ["é" * 40, "-" * 130, " " * 90 + "end"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(pool)
            a = rng.randrange(len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[:len(p) - a], prose(1000 + rng.randrange(10**6), 8)]))
        rows.append((rng.choice([i, i, i, i // 2]), rng.choice(["", " ", "\n", "中"]).join(parts)))
    return rows


def test_report_equals_brute_force(spark):
    rows = passages(1, 90) + [(None, prose(1, 30)), (None, None), (500, None), (501, ""), (502, prose(1, 30)[:49]), (503, prose(1, 30)[:50]), (504, prose(1, 30)[:50])]
    assert report(spark, rows) == brute(rows)


def test_small_batches_and_blocks(spark, monkeypatch):
    """Many blocks, each sorted apart, give the same rows."""
    rows = passages(2, 60)
    found = [s for s, _ in [((t or "").encode(), d) for d, t in rows]]
    assert report(spark, rows, 7) == brute(rows)
    owner = np.array([d for d, _ in rows])
    keep = [k for k, s in enumerate(found) if len(s) >= sd.LENGTH]
    masks = sd.covered([found[k] for k in keep], owner[keep])
    least: dict[bytes, int] = {}
    for k in keep:
        for i in range(len(found[k]) - sd.LENGTH + 1):
            s = found[k][i:i + sd.LENGTH]
            least[s] = min(least.get(s, owner[k]), owner[k])
    for k, mask in zip(keep, masks):
        assert mask.tolist() == [least[found[k][i:i + sd.LENGTH]] < owner[k] for i in range(len(found[k]) - sd.LENGTH + 1)]


def test_hot_group_of_copies(spark):
    rows = [(i, prose(5, 60)) for i in range(400)] + [(i, prose(5, 60) + f" tail {i} " + prose(i, 10)) for i in range(400, 500)] + [(i, prose(i, 20)) for i in range(500, 800)]
    assert report(spark, rows) == brute(rows)


def test_awkward_rows_and_clashing_columns(spark):
    df = awkward(spark, "raw block anchor row at size")
    got = sorted((tuple(r[c] for c in COLUMNS) for r in sd.report(df).collect()), key=str)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sd.report(empty(spark)).count() == 0


def test_remainders(spark):
    rows = passages(3, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in sd.remainders(df).collect()), key=str)
    assert got == sorted([(d, n, s, h) for d, _, n, s, h in brute(rows)], key=str)
