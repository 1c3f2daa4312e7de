"""Fingerprints: the edited texts, equal texts, likeness against the true similarity, order and awkward rows."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from runtally.llm import imatch
from tests.llm.cases import awkward, empty

DATA = "/root/testdata/sf0.01/documents.parquet"


def brute(rows):
    rows = sorted(((k is not None, k or 0, t is not None, t or "") for k, t in rows))
    out = []
    for (has, k, _, t), (_, _, _, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        out.append((k if has else None, len(t), hashlib.sha256((t[:len(t) - q] + after[:q]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_edited_texts(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for df in (spark.read.parquet(DATA), awkward(spark, "part ahead order key")):
            got = imatch.compare_edited(df).collect()
            assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=str) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_likeness(spark):
    docs = spark.read.parquet(DATA)
    rows = imatch.compare_edited(docs).collect()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95
    by_text = {}
    for r, t in docs.join(imatch.compare_edited(docs), "doc_id").select("text", "fingerprint").collect():
        by_text.setdefault(r, set()).add(t)
    assert all(len(x) == 1 for x in by_text.values())


def test_lexicon_counts_documents(spark):
    docs = spark.createDataFrame([(i, "every one" + (" some" * 3 if i % 20 == 0 else "") + f" rare{i}") for i in range(100)], "doc_id long, text string")
    names = {int(x): w for w in ("every", "one", "some", "rare1") for x in imatch.term_sets([w])[0]}
    assert [names[int(x)] for x in imatch.lexicon(docs)] == ["some"]


def test_terms_are_hashed_and_not_remembered():
    tracemalloc.start()
    for at in range(0, 40_000, 4000):
        texts = [" ".join(f"Once{i} É{i}" for i in range(j, j + 200)) + " once" for j in range(at, at + 4000, 200)] + ["", " .\n"]
        got = imatch.term_sets(texts)
        assert [x.tolist() for x in got] == [sorted({xxhash.xxh3_64_intdigest(w) for w in t.lower().replace(".", "").split()}) for t in texts]
    del texts, got
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1_000_000


def test_one_and_none(spark):
    one = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    r = imatch.compare_edited(one).collect()
    assert len(r) == 1 and r[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r[0]["near_next"] == 1.0
    assert imatch.compare_edited(empty(spark)).count() == 0
    same = one.union(one).withColumn("x", F.lit(1))
    assert [x["near_next"] for x in imatch.compare_edited(same).collect()] == [1.0, 1.0]


def jaccard(a, b):
    a, b = (set(map(int, x)) for x in imatch.term_sets([a, b]))
    return len(a & b) / len(a | b)


def test_copies_of_a_third_of_the_rows(spark):
    rows = [(3 * i, r["text"]) for i, r in enumerate(spark.read.parquet(DATA).where("length(text) > 400").orderBy("doc_id").limit(800).collect())]
    hot = "Zorn quibbles vex dwarfs; jumbled oxen grazed mutely by foggy wharves, hence twelve pickled lemons clanged awkwardly."
    rows += [(3 * i + 1, hot) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by_id, order = dict(rows), sorted(x for x, _ in rows)
    after = dict(zip(order, order[1:] + order[:1]))
    got = {r["doc_id"]: r for r in imatch.compare_edited(df).collect()}
    for name, other in (("near_edited", lambda i: imatch.edited(hot, by_id[after[i]])), ("near_next", lambda i: by_id[after[i]])):
        pairs = [(got[i][name], jaccard(hot, other(i))) for i, t in rows if t == hot]
        assert np.mean([abs(x - y) for x, y in pairs]) < 0.12, name
    assert any(got[i]["fingerprint"][0] != got[i]["edited_fingerprint"][0] for i, t in rows if t == hot)
    assert all(got[i]["near_edited"] > 0.3 for i, t in rows if t == hot)


@pytest.mark.parametrize("small, large", [(7, 28), (5, 20), (15, 60), (100, 400)])
def test_sizes_a_factor_of_four_apart(small, large):
    words = [f"word{i}" for i in range(large)]
    a, b = imatch.fingerprints([" ".join(words[:small]), " ".join(words)], np.zeros(0, np.uint64))
    assert 0.1 < a.likeness(b) <= 0.25 and a.likeness(b) == b.likeness(a)
