"""Language by compression on held-out and awkward rows."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from runtally.llm import language
from tests.llm.cases import awkward, empty

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_are_no_input(spark):
    docs = spark.read.parquet(DATA)
    model = language.learn(docs, F.lit(True))
    blank = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 10**6})
    a = sorted((r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect())
    assert a == sorted((r["lang_pred"], r["score"]) for r in language.predict(blank, model).collect())


def test_awkward(spark):
    df = awkward(spark, "lang_pred score key held_out")
    rows = language.identify(df).collect()
    assert len(rows) == df.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (3, 4, 5))
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert language.identify(empty(spark)).count() == 0
    nothing = language.learn(df, F.lit(False))
    assert nothing.names == () and {r["lang_pred"] for r in language.predict(df, nothing).collect()} == {"und"}


def test_rejection_keeps_columns(spark):
    df = awkward(spark, "score")
    model = language.learn(df, F.lit(True))
    kept = language.keep_known(df, model)
    assert kept.schema == df.schema
    left = {r["doc_id"] for r in kept.collect()}
    assert not left & {3, 4, 5} and {1, 2, 7} <= left


def test_hot_text_cannot_fill_a_dictionary(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same words again").alias("text"), F.lit("en").alias("lang")).union(
        spark.createDataFrame([(1000 + i, f"und der satz {i} ist anders", "de") for i in range(5)], "doc_id long, text string, lang string"))
    model = language.learn(docs, F.lit(True))
    assert model.names == ("en", "de") and model.dictionaries[0] == b"same words again"


def test_copies_do_not_lessen_what_is_learned(spark):
    few = [(f"text {chr(97 + i)} is copied very often", "en") for i in range(3)] + [(f"und der satz {chr(97 + i)} ist anders", "de") for i in range(5)]
    few = spark.createDataFrame(few, "text string, lang string")
    docs = few.where("lang = 'en'").crossJoin(spark.range(50_000)).select("text", "lang").union(few.where("lang = 'de'"))
    model, once = language.learn(docs, F.lit(True)), language.learn(few, F.lit(True))
    assert model.names == ("en", "de") and once.names == ("de", "en")
    assert dict(zip(model.names, model.dictionaries)) == dict(zip(once.names, once.dictionaries))
    assert all(b"text %s is copied" % x in model.dictionaries[0] for x in (b"a", b"b", b"c"))


def test_hot_text_of_many_rows_is_learned(spark):
    docs = spark.range(50_000).select(F.lit("same words again").alias("text"), F.lit("en").alias("lang"))
    assert language.learn(docs, F.lit(True)).dictionaries == (b"same words again",)


def test_what_follows_a_common_header_is_learned(spark):
    header = "\n".join(f"line {chr(97 + i % 26) * 3} of the common header" for i in range(40))
    docs = spark.createDataFrame([(f"{header}\nvery own words {chr(97 + i // 26)}{chr(97 + i % 26)} of this text", "en") for i in range(400)], "text string, lang string")
    model = language.learn(docs, F.lit(True))
    assert sum(b"very own words" in x for x in model.dictionaries[0].split(b"\n")) > 100
    assert len(model.dictionaries[0]) <= language.SAMPLE * language.SHARE


def test_lines_come_from_the_whole_text():
    text = "\n".join(f"line {i} of a long text" for i in range(1000)) + "\n" + "x" * 5000
    got = language.some_lines(text, 700, 1)
    own = [int(x.split()[1]) for x in got.split("\n") if x.endswith("text")]
    assert len(got) <= 700 and own == sorted(own) and own[-1] > 500
    assert language.some_lines("a\nb\na", 700, 1) == "a\nb" and len(language.some_lines("y" * 5000, 700, 1)) == 700
