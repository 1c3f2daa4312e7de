"""Later repeated runs of lines against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

from runtally.llm import line_winnow
from tests.llm.cases import awkward, empty, prose


def brute(rows, words):
    """(key, kept lines) by trying every run of whole lines with enough words against all that came before."""
    rows = sorted(rows)
    docs = [(k, t.split("\n")) for k, t in rows]
    weight = [[len(x) - len(x.replace(" ", "")) + 1 for x in lines] for _, lines in docs]
    seen, out = {}, []
    for d, (key, lines) in enumerate(docs):
        runs = []
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                if sum(weight[d][i:j + 1]) >= words:
                    runs.append((i, j))
        gone = set()
        minimal = {(i, min(j for a, j in runs if a == i)) for i, _ in runs} | {(max(i for i, b in runs if b == j), j) for _, j in runs}
        for i, j in sorted(minimal):
            first = seen.setdefault(tuple(lines[i:j + 1]), (d, i, j))
            if first[0] != d or i > first[2]:
                gone |= set(range(i, j + 1))
        out.append((key, [x for p, x in enumerate(lines) if p not in gone], len(lines)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    pool = [prose(i, rng.choice([1, 3, 8, 20, 60])) for i in range(14)] + [""]
    rows = []
    for k in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.6 else prose(1000 * seed + 50 * k + i, rng.choice([2, 9, 30])) for i in range(rng.randint(1, 9))]
        if k % 7 == 0:
            lines += ["\n".join(pool[2:6])]
        rows.append((k, "\n".join(lines)))
    return rows + [(100 + i, prose(5, 60)) for i in range(10)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_report(spark, seed):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["left_sha256"]) for r in line_winnow.report(spark.createDataFrame(rows, "doc_id long, text string"), 25).collect()}
    want = {k: (n, n - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()) for k, left, n in brute(rows, 25)}
    assert got == want and sum(x[1] for x in want.values()) > 50


def test_deletion(spark):
    rows = corpus(4)
    want = {k: "\n".join(left) for k, left, n in brute(rows, 25) if left}
    df = spark.createDataFrame([(k, t, "en", len(t)) for k, t in rows], "doc_id long, text string, lang string, n_chars long")
    out = line_winnow.delete_repeats(df, 25)
    assert out.schema.simpleString() == df.schema.simpleString()
    got = {r["doc_id"]: r for r in out.collect()}
    assert {k: r["text"] for k, r in got.items()} == want and all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_awkward(spark):
    df = awkward(spark, "o th pos runs i j f w u")
    rows = line_winnow.report(df).collect()
    assert len(rows) == df.count()
    assert [(r["n_lines"], r["n_removed"], r["left_sha256"]) for r in rows if r["doc_id"] == 3] == [(0, 0, None)]
    assert [r["n_removed"] for r in rows if r["doc_id"] == 4] == [0]
    assert {r["n_removed"] for r in rows if r["doc_id"] == 2} == {0, 1}  # the text of 1 again, and a text of its own twice
    out = line_winnow.delete_repeats(df)
    assert out.schema == df.schema and out.count() == df.count() - 1
    assert line_winnow.report(empty(spark)).count() == 0 and line_winnow.delete_repeats(empty(spark)).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame(corpus(1), "doc_id long, text string")
    plan = line_winnow.delete_repeats(df)._jdf.queryExecution().toString() + line_winnow.repeated_runs(df)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions"))
