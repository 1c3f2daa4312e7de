from __future__ import annotations

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from runtally.operators import ordered as o, windows as w
from runtally.operators.joins import blocking_sessions, overlaps
from tests.conftest import rows


def test_numbered_one_hot_group_spreads_over_tasks(spark):
    """A group with most rows is numbered without gaps though it lies in several partitions."""
    n = 40_000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 300).cast("string"))).alias("k"),
                               (F.col("id") * 7919 % n).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = o.numbered(df, ["k"], ["v"], "rn").cache()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = df.selectExpr("k", "v", "row_number() over (partition by k order by v) rn")
    assert out.exceptAll(want).count() == 0 and out.count() == n


def test_numbered_nulls_and_descending(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", None)], "k string, v int")
    got = rows(o.numbered(df, ["k"], [F.desc_nulls_last("v")], "rn"), "k", "v", "rn")
    assert got == sorted([("a", 3, 1), ("a", None, 2), (None, 2, 1), (None, 1, 2)], key=lambda t: tuple((x is None, str(x)) for x in t))
    assert o.numbered(df.limit(0), ["k"], ["v"], "rn").count() == 0


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 50), st.integers(-3, 9)), max_size=50, unique_by=lambda t: t[:2]))
def test_scan_numbers_and_sums_in_one_pass(spark, data):
    df = spark.createDataFrame(data, "k string, at int, x int").repartition(3)
    got = {(r["k"], r["at"]): (r["no"], r["s"]) for r in o.scanned(df, ["k"], ["at"], number="no", sums={"s": "x"}).collect()}
    assert got == {(k, at): (sum(j == k and b <= at for j, b, _ in data), sum(y for j, b, y in data if j == k and b <= at)) for k, at, _ in data}


def test_near_values_are_spread_over_tasks(spark, monkeypatch):
    """One key with 300,000 distinct values within one second: no piece above twice its share, and the statistics are exact."""
    n, pieces = 300_000, []
    real = o.cut

    def spy(df):
        out = real(df)
        if "_piece" in out.columns:
            pieces.extend(r["count"] for r in out.groupBy("_piece").count().collect())
        return out

    monkeypatch.setattr(o, "cut", spy)
    df = spark.range(n).select(F.lit("hot").alias("k"), (1 + (F.col("id") * 7919 % n) / n).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = o.order_statistics(o.histogram(df, ["k"], "v"), ["k"], "v", {**o.QUARTILES, **o.MIDDLES}).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(pieces) == 4 and max(pieces) < 2 * n / 4
    assert [got[c] for c in ("n", "q1", "q3", "mid_low", "mid_high")] == [n, *(1 + k / n for k in (n // 4, 3 * n // 4, (n - 1) // 2, n // 2))]


def test_numbered_over_everything(spark):
    got = o.numbered(spark.range(1000).withColumn("v", F.col("id") * 37 % 1000), [], ["v"], "rn")
    assert got.filter("rn <> v + 1").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 4000).map(lambda x: x / 1000)), min_size=1, max_size=60))
def test_order_statistics_equal_sorted_lists(spark, data):
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in o.order_statistics(o.histogram(df, ["k"], "v"), ["k"], "v", {**o.QUARTILES, **o.MIDDLES}).collect()}
    for k in {k for k, _ in data}:
        d = sorted(v for x, v in data if x == k)
        n = len(d)
        assert got[k]["n"] == n
        assert got[k]["q1"] == (d[n // 4] if n >= 4 else d[0])
        assert got[k]["q3"] == (d[3 * n // 4] if n >= 4 else d[-1])
        assert (got[k]["mid_low"] + got[k]["mid_high"]) / 2 == (d[(n - 1) // 2] + d[n // 2]) / 2


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["r1", "r2"]), st.integers(0, 200), st.integers(0, 30), st.booleans()), min_size=1, max_size=40))
def test_sweep_equals_pairs(spark, data):
    """Starts and lengths are drawn small so that equal instants and empty intervals are common."""
    recs = [(k, i, s * 20_000_000, (s + d) * 20_000_000, f) for i, (k, s, d, f) in enumerate(data)]
    df = spark.createDataFrame(recs, "instance string, session int, s long, e long, exclusive boolean").select(
        "instance", "session", F.timestamp_micros("s").alias("start_time"), F.timestamp_micros("e").alias("end_time"), "exclusive")

    def hit(a, b):
        return a[0] == b[0] and a[1] != b[1] and b[2] < a[3] and b[3] > a[2]

    got = {r["session"]: r["n"] for r in overlaps(df, ["instance"], {"n": None}).collect()}
    assert got == {a[1]: sum(hit(a, b) for b in recs) for a in recs}
    block = {r["session"]: (r["blocking"], r["must_wait"]) for r in blocking_sessions(df).collect()}
    want = {a[1]: sum(hit(a, b) and (a[4] or b[4]) for b in recs) for a in recs}
    assert block == {k: (v, v > 0) for k, v in want.items()}


def test_sweep_without_times(spark):
    df = spark.createDataFrame([("r", 1, None, None), ("r", 2, 0, 10), ("r", 3, 5, 6)], "k string, id int, s long, e long").select(
        "k", "id", F.timestamp_micros("s").alias("start_time"), F.timestamp_micros("e").alias("end_time"))
    assert rows(overlaps(df, ["k"], {"n": None}), "id", "n") == [(1, 0), (2, 1), (3, 1)]


def test_sweep_keeps_rows_with_equal_or_no_ids(spark):
    df = spark.createDataFrame([("r", 1, 0, 5), ("r", 1, 1, 6), ("r", None, 2, 7), (None, None, 0, 9), (None, None, 0, 9)], "k string, id int, s long, e long").select(
        "k", "id", F.timestamp_seconds("s").alias("start_time"), F.timestamp_seconds("e").alias("end_time"))
    assert sorted((r["k"] or "", r["id"] or 0, r["n"]) for r in overlaps(df, ["k"], {"n": None}).collect()) == [
        ("", 0, 1), ("", 0, 1), ("r", 0, 2), ("r", 1, 2), ("r", 1, 2)]


def test_touching_intervals_do_not_overlap(spark):
    df = spark.createDataFrame([("r", 1, 0, 2), ("r", 2, 2, 5)], "k string, id int, s long, e long").select(
        "k", "id", F.timestamp_seconds("s").alias("start_time"), F.timestamp_seconds("e").alias("end_time"))
    assert rows(overlaps(df, ["k"], {"n": None}), "id", "n") == [(1, 0), (2, 0)]


def test_default_estimate_values(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 30.0), ("a", 100.0), ("b", None), ("c", 50.0), ("d", 0.0)], "workflow string, ewma double")
    assert rows(w.default_estimate(df)) == [("a", 10.0), ("b", 10.0), ("c", 50.0), ("d", 10.0)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 30).map(lambda x: x / 2), min_size=1, max_size=50))
def test_default_estimate_equals_list_slice(spark, values):
    df = spark.createDataFrame([("w", v) for v in values], "workflow string, ewma double")
    k = max(1, len(values) // 4)
    assert abs(w.default_estimate(df).first()["default_estimate"] - sum(sorted(values)[:k]) / k) < 1e-9


def test_running_sums_many_blocks(spark):
    random.seed(1)
    data = [("k", i, random.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(data, "k string, at int, n int")
    got = {r["at"]: r["s"] for r in o.running_sums(df, ["k"], "at", F.floor(F.col("at") / 7), {"s": "n"}).collect()}
    total = 0
    for _, at, n in data:
        total += n
        assert got[at] == total


def test_small_groups_need_no_piece_and_large_ones_do(spark, monkeypatch):
    """Numbers, sums and sizes of groups on both sides of the bound; groups below it are not range-partitioned."""
    df = spark.range(400).select(F.when(F.col("id") < 300, None).otherwise((F.col("id") % 7).cast("string")).alias("k"), (F.col("id") * 37 % 400).alias("v"), F.lit(2).alias("x"))
    want = rows(df.selectExpr("k", "v", "row_number() over (partition by k order by v)", "2 * row_number() over (partition by k order by v)", "count(*) over (partition by k)"))
    scan = lambda: rows(o.scanned(df, ["k"], ["v"], number="no", sums={"s": "x"}, size="n"), "k", "v", "no", "s", "n")
    with monkeypatch.context() as m:
        m.setattr(o, "cut", None)
        assert scan() == want
    monkeypatch.setattr(o, "WHOLE", 50)
    assert scan() == want
    monkeypatch.setattr(o, "WHOLE", 0)
    assert scan() == want


def test_groups_are_counted_only_in_full_buckets(spark, monkeypatch):
    """without a bucket of more than ``WHOLE`` rows no group is counted by itself."""
    monkeypatch.setattr(o, "kept", None)
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 4)], "k string, x int")
    assert sorted(map(tuple, o.scanned(df, ["k"], ["x"], number="n", size="m").collect()), key=str) == sorted([("a", 1, 1, 2), ("a", 2, 2, 2), (None, 4, 1, 2), (None, 5, 2, 2)], key=str)
