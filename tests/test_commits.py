"""History tables changed by workflow."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F, types as T

from runtally.sources import commits

SCHEMA = T.StructType([T.StructField("workflow", T.StringType()), T.StructField("run_id", T.StringType()),
                       T.StructField("start_time", T.TimestampType()), T.StructField("n", T.IntegerType())])
DAY = dt.datetime(2024, 1, 1)


def history(spark):
    flows = ["a", "b", "c/ =%", "7", "", None]
    return spark.createDataFrame([(w, f"r{i}_{k}", DAY + dt.timedelta(days=k), i) for i, w in enumerate(flows) for k in range(3)], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in pathlib.Path(path, "data").rglob("*.parquet")}


@pytest.fixture
def path(spark, tmp_path):
    commits.create(history(spark), str(tmp_path / "t"))
    return str(tmp_path / "t")


def test_round_trip_and_append(spark, path):
    want = rows(history(spark))
    assert rows(commits.current(spark, path, SCHEMA)) == want
    before = files(path)
    commits.append(history(spark).limit(0), path)
    commits.append(history(spark).where("workflow = 'a'"), path)
    assert rows(commits.current(spark, path, SCHEMA)) == sorted(want + [r for r in want if r[0] == "a"], key=str)
    assert before.items() <= files(path).items()
    assert rows(commits.current(spark, path, SCHEMA, version=1)) == want


@pytest.mark.parametrize("which, gone", [
    ({"workflow": "a"}, lambda r: r[0] == "a"), ({"workflow": ""}, lambda r: r[0] == ""), ({"workflow": "none"}, lambda r: False),
    ({"run_id": "r2_1"}, lambda r: r[1] == "r2_1"), ({"run_id": "r5_0"}, lambda r: r[1] == "r5_0"),
    ({"before": DAY + dt.timedelta(days=1)}, lambda r: r[2] < DAY + dt.timedelta(days=1)), ({}, lambda r: True)])
def test_purge_touches_its_workflows_only(spark, path, which, gone):
    want, before = rows(history(spark)), files(path)
    commits.purge_files(spark, path, SCHEMA, **which)
    assert rows(commits.current(spark, path, SCHEMA)) == [r for r in want if not gone(r)]
    after = files(path)
    assert before.items() <= after.items()
    new = spark.read.parquet(*[p for p in after if p not in before]) if len(after) > len(before) else history(spark).limit(0)
    assert {r[0] for r in new.select("workflow").collect()} <= {r[0] for r in want if gone(r)}


def test_lost_commit_leaves_the_old_version(spark, path):
    """Data without a listing, and a listing that lacks rows, do not count; the next commit goes on from the whole version."""
    want = rows(history(spark))
    batch = commits._store(history(spark), path)
    assert rows(commits.current(spark, path, SCHEMA)) == want
    spark.createDataFrame([(batch, "w:a", 3, 2)], commits.LISTING).write.mode("append").parquet(f"{path}/versions")
    assert rows(commits.current(spark, path, SCHEMA)) == want
    with pytest.raises(Exception):
        commits.rewrite(spark, path, SCHEMA, history(spark), lambda old: old.withColumn("n", F.raise_error(F.lit("lost")).cast("int")))
    assert rows(commits.current(spark, path, SCHEMA)) == want
    commits.purge_files(spark, path, SCHEMA, workflow="a")
    assert rows(commits.current(spark, path, SCHEMA)) == [r for r in want if r[0] != "a"]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "empty")
    commits.create(history(spark).limit(0), path)
    assert commits.current(spark, path, SCHEMA).count() == 0
    commits.append(history(spark), path)
    commits.purge_files(spark, path, SCHEMA)
    assert commits.current(spark, path, SCHEMA).count() == 0
    assert [tuple(r) for r in commits.versions(spark, path).orderBy("version").collect()] == [(0, 0), (1, 0), (2, 6), (3, 0)]
