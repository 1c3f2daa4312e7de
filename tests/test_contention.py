from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runtally.operators import joins as j, windows as w
from runtally.plans import contention as c, estimates as e
from runtally.schemas import RUNS, TASKS, conform
from tests.conftest import rows

T0 = datetime(2024, 1, 1)


def params(spark, data):
    """(task, parameters, estimate) of one workflow."""
    df = spark.createDataFrame([("wf", str(i), f"s{i}", p, v, i) for i, (p, v) in enumerate(data, 1)],
                               "workflow string, task_id string, task_signature string, parameters map<string,string>, ewma double, pos int")
    return df


def driver_of(spark, data, ratio=5.0):
    tp = params(spark, data)
    impact = c.parameter_impact(c.parameter_groups(tp, c.varying_parameters(tp)))
    return c.contention_driver(impact, ratio).first()


def test_driver_clear(spark):
    base = {"A": 100.0, "B": 80.0, "C": 10.0, "D": 12.0}
    data = [({"pSegment": s, "pPeriod": str(p + 1), "pMode": "x"}, v + p) for s, v in base.items() for p in range(3)]
    got = driver_of(spark, data)
    assert got["driver"] == "pSegment" and got["range_seconds"] == pytest.approx(90)


def test_driver_ambiguous_and_single(spark):
    data = [({"X": x, "Y": y}, v) for (x, y), v in zip([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")], [10.0, 20.0, 15.0, 25.0])]
    assert driver_of(spark, data)["driver"] is None
    one = driver_of(spark, [({"X": "a"}, 10.0), ({"X": "b"}, 100.0)])
    assert (one["driver"], one["range_seconds"]) == ("X", 90.0)
    # A task that lacks the parameter is a group of its own.
    tp = params(spark, [({"X": "a"}, 1.0), ({"X": "b"}, 2.0), ({}, 50.0)])
    assert rows(c.parameter_groups(tp, c.varying_parameters(tp)), "value", "avg_estimate") == [("", 50.0), ("a", 1.0), ("b", 2.0)]


def groups(spark, values):
    return spark.createDataFrame([("wf", f"g{i:03d}", float(v), 1) for i, v in enumerate(values)], "workflow string, driver_value string, avg_duration double, task_count long")


def test_heavy_outliers(spark):
    g = w.heavy_outliers(groups(spark, [10 + 0.2 * i for i in range(60)] + [200, 180, 150]), ["workflow"], 10.0)
    assert rows(g.groupBy("is_heavy").count()) == [(False, 60), (True, 3)]
    order = w.heavy_rank(g, ["workflow"]).orderBy("chain_rank").collect()
    assert [r["avg_duration"] for r in order] == [200, 180, 150]
    assert w.heavy_outliers(groups(spark, [1, 2, 300]), ["workflow"]).filter("is_heavy").count() == 0
    same = w.heavy_outliers(groups(spark, [10] * 10), ["workflow"]).first()
    assert same["iqr"] == 0 and not same["is_heavy"]


def chains(spark, heavy, periods):
    tasks = [("wf", str(i + 1), {"d": h, "pPer": p}, i) for i, (h, p) in enumerate((h, p) for h in heavy for p in periods)]
    tp = spark.createDataFrame(tasks, "workflow string, task_id string, parameters map<string,string>, pos int")
    hv = spark.createDataFrame([("wf", "d", h, i + 1) for i, h in enumerate(heavy)], "workflow string, driver string, driver_value string, chain_rank long")
    fan = spark.createDataFrame([("wf", ["pPer"])], "workflow string, fan_out_keys array<string>")
    return rows(j.chain_edges(tp, hv, fan), "task_id", "predecessor")


def test_chains(spark):
    assert chains(spark, ["h1", "h2"], ["1", "2", "3"]) == [("4", "1"), ("5", "2"), ("6", "3")]
    # Three heavy groups by two periods: ids run group by group.
    assert chains(spark, ["h1", "h2", "h3"], ["1", "2"]) == [("3", "1"), ("4", "2"), ("5", "3"), ("6", "4")]


def test_recommend_workers(spark):
    g = spark.createDataFrame([("a", "h1", 200.0, 2, True), ("a", "h2", 100.0, 2, True), ("a", "l", 10.0, 8, False), ("b", "h1", 5.0, 1, True), ("b", "h2", 4.0, 1, True)],
                              "workflow string, driver_value string, avg_duration double, task_count long, is_heavy boolean")
    fan = spark.createDataFrame([("a", ["k"], 2), ("b", ["k"], 12)], "workflow string, fan_out_keys array<string>, fan_out_size long")
    assert rows(c.recommend_workers(g, fan), "workflow", "recommended_workers") == [("a", 3), ("b", 12)]


def history(spark, runs, tasks):
    r = spark.createDataFrame([(f"r{i}", "wf", T0 - timedelta(days=i), float(d), s, m) for i, (m, d, s) in enumerate(runs)],
                              "run_id string, workflow string, start_time timestamp, duration_seconds double, status string, max_workers int")
    k = spark.createDataFrame([(i, run, "wf", tid, sig, p, "Success", T0 + timedelta(seconds=a), T0 + timedelta(seconds=a + d), float(d))
                               for i, (run, tid, sig, p, a, d) in enumerate(tasks)],
                              "id long, run_id string, workflow string, task_id string, task_signature string, parameters map<string,string>, status string, start_time timestamp, end_time timestamp, duration_seconds double")
    return conform(r, RUNS), conform(k, TASKS)


def totals(run, total, n=10):
    """Tasks of a run that add up to ``total`` seconds, one after the other."""
    return [(run, str(i), f"{run}{i}", {}, i * total, total / n) for i in range(n)]


def ceiling(spark, levels):
    """levels: (workers, wall, total), newest first."""
    r, k = history(spark, [(m, d, "Success") for m, d, _ in levels], [t for i, (_, _, total) in enumerate(levels) for t in totals(f"r{i}", total)])
    return c.concurrency_ceiling(r, k).collect()


def test_ceiling_multi_run(spark):
    got = ceiling(spark, [(30, 600, 10000), (50, 800, 20000)])[0]
    assert (got["confidence"], got["ceiling_workers"], got["wall_clock_improvement"], got["wall_clock_improvement_pct"]) == ("multi_run", 15, 200.0, 25.0)


def test_ceiling_scaling_fine(spark):
    assert ceiling(spark, [(50, 400, 8000), (30, 600, 9000)]) == []


def test_ceiling_scale_up(spark):
    got = ceiling(spark, [(5, 734, 2952), (10, 581, 3489), (24, 692, 5872), (50, 547, 5684)])[0]
    assert (got["confidence"], got["ceiling_workers"], got["wall_clock_improvement"]) == ("scale_up", 10, 153.0)


def test_ceiling_single_run(spark):
    # Task i starts early enough to meet ever more others: longer tasks saw more concurrency.
    tasks = [("r0", str(i), f"s{i}", {}, 0, 100 + 8 * i) for i in range(50)] + [("r0", f"x{i}", f"x{i}", {}, 90 + 8 * i, 1) for i in range(50)]
    r, k = history(spark, [(50, 600, "Success")], tasks)
    corr = c.concurrency_correlation(k).first()
    assert corr["correlation"] > 0.7
    got = c.concurrency_ceiling(r, k).first()
    assert (got["confidence"], got["ceiling_workers"]) == ("single_run", 25) and got["efficiency"] < 0.75


def test_correlation_edges(spark):
    _, k = history(spark, [(1, 1, "Success")], [("two", "1", "a", {}, 0, 5), ("two", "2", "b", {}, 1, 5), ("flat", "1", "a", {}, 0, 1),
                                                ("flat", "2", "b", {}, 5, 1), ("flat", "3", "c", {}, 9, 1)])
    assert rows(c.concurrency_correlation(k), "run_id", "correlation") == [("flat", 0.0), ("two", 0.0)]


def _segments(spark):
    values = {**{f"S{i}": 10.0 + i for i in range(8)}, "S8": 200.0, "S9": 180.0}
    tasks = [("r0", str(n + 1), f"{s}{p}", {"pSegment": s, "pPeriod": str(p)}, n * 1000, v)
             for n, (s, p, v) in enumerate((s, p, v) for s, v in values.items() for p in range(3))]
    return history(spark, [(4, 500, "Success")], tasks)


def test_report(spark):
    r, k = _segments(spark)
    got = c.contention_report(r, k, sensitivity=1.5).first()
    assert (got["contention_driver"], got["fan_out_keys"], got["fan_out_size"], got["chain_length"], got["critical_path_seconds"]) == ("pSegment", "pPeriod", 3, 2, 380.0)
    # Light work 3 * (10 + … + 17) = 324 s fits the 380 s of a chain: one more worker.
    assert (got["recommended_workers"], got["chained_tasks"], got["warning"]) == (4, 3, None)
    assert c.optimization_choice(c.contention_report(r, k, sensitivity=1.5)).first()["choice"] == "chains"
    calm = c.contention_report(r, k, sensitivity=1000.0).first()
    assert (calm["chain_length"], calm["recommended_workers"]) == (0, 3) and calm["warning"].startswith("Only 0 heavy")
    assert c.optimization_choice(c.contention_report(r, k, sensitivity=1000.0)).first()["choice"] == "longest_first"


def test_report_without_signal(spark):
    r, k = history(spark, [(4, 500, "Success")], [("r0", str(i), f"s{i}", {"p": "same"}, i * 10, 5) for i in range(5)])
    got = c.contention_report(r, k).first()
    assert got["warning"].startswith("No varying parameters") and got["recommended_workers"] == 0
    r, k = history(spark, [(4, 500, "Failed")], [("r0", "1", "s", {"p": "x"}, 0, 5)])
    assert c.contention_report(r, k).first()["warning"] == "No task data found for workflow"
    none = k.withColumn("status", F.lit("Fail"))
    assert c.contention_report(r, none).first()["warning"] == "No historical data found for workflow"


def test_driver_major_order(spark):
    r, k = _segments(spark)
    a = c.analyze(r, k, 1.5)
    defs = k.select("workflow", F.lit(None).cast("string").alias("run_id"), F.col("task_id").cast("long").alias("pos"), F.col("task_id").alias("id"),
                    "parameters", F.array().cast("array<string>").alias("predecessors"))
    out = j.driver_major_order(defs, a.groups.select("workflow", "driver", "driver_value", "avg_duration", "is_heavy"), a.chains, a.workers).orderBy("new_pos").collect()
    assert [r["id"] for r in out[:9]] == ["25", "26", "27", "28", "29", "30", "22", "23", "24"]
    assert {r["id"]: r["predecessors"] for r in out if r["predecessors"]} == {"28": ["25"], "29": ["26"], "30": ["27"]}
    assert {r["recommended_workers"] for r in out} == {4}


def test_report_rows_follow_the_two_rules(spark):
    """One sample is steady in the report and middling in the estimate; zero durations count for neither."""
    tasks = [("r0", "1", "one", {}, 0, 100), ("r0", "2", "zero", {}, 0, 0)]
    _, k = history(spark, [(1, 1, "Success")], tasks)
    k = k.unionByName(k.filter("task_id = '1'").withColumn("status", F.lit("Fail")).withColumn("task_signature", F.lit("never")).withColumn("id", F.lit(9).cast("long")))
    rep = {r["task_signature"]: r for r in e.analyze_runs(k).collect()}
    assert set(rep) == {"one", "never"}
    assert rep["one"]["confidence"] == pytest.approx(0.55) and rep["never"]["estimated"] and rep["never"]["ewma"] == 100.0
    est = {r["task_signature"]: r for r in e.runtime_estimates(k).collect()}
    assert est["one"]["confidence"] == pytest.approx(0.30) and est["zero"]["estimated"] and est["zero"]["ewma"] == 100.0
    assert w.ewma(k).filter("task_signature = 'zero'").first()["ewma"] == 0.0
