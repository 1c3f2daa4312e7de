"""The pipeline as a whole and its registered queries."""

from __future__ import annotations

import glob
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from runtally.llm.rows import CLEANUP, kept
from tests.llm.cases import awkward, prose, token
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in entry.queries() if n[:2] == "op" and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n[:2] == "op" and n[2].isdigit()))
def test_queries_with_sql(spark, name):
    ok, message = compare(spark, connect(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, message


def test_stages(spark, tmp_path):
    secret = token(3, 40, "0123456789abcdef")
    texts = [prose(i, 150) for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    shared = prose(900, 70)
    rows += [(100, texts[0], "en", "s", 1), (101, texts[1] + " end", "en", "s", 1), (102, f"{shared}\n{prose(7000, 50)}", "en", "s", 1),
             (103, f"{prose(7001, 50)}\n{shared}", "en", "s", 1), (104, f"{prose(8000, 60)} token = {secret}", "en", "s", 1), (105, "1234 5678 !!!", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    ids = {name: {r["doc_id"] for r in found} for name, found in after.items()}
    text = {name: {r["doc_id"]: r["text"] for r in found} for name, found in after.items() if name != "packing"}
    assert 105 not in ids["language"] and ids["language"] == set(range(40)) | {100, 101, 102, 103, 104}
    assert 100 not in ids["line_dedup"] and text["line_dedup"][103] == prose(7001, 50)
    assert 101 not in ids["near_dedup"] and 1 in ids["near_dedup"]
    assert secret not in text["secrets"][104] and text["secrets"][0] == texts[0]
    assert ids["packing"] == ids["secrets"] == ids["near_dedup"] == set(range(40)) | {102, 103, 104}


def test_awkward_stages(spark):
    docs = awkward(spark, "node row key runs")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_kept_frames_leave_no_shuffle_files(spark):
    def files():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p for d in dirs for p in glob.glob(f"{d}/*/shuffle_*")}

    before, setting = files(), spark.conf.get(CLEANUP, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    found = kept(counts)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(CLEANUP, None) == setting
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, counts.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
