from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from runtally.operators import history as h, joins as j, summaries, windows as w
from runtally.schemas import RUNS, TASKS, conform
from tests.conftest import rows

NOW = datetime(2024, 5, 1, 12)


@pytest.fixture(scope="module")
def seed(spark):
    """Three runs of two workflows with four task rows."""
    t = lambda days, s=0: NOW - timedelta(days=days) + timedelta(seconds=s)
    runs = [("run1", "taskfile1", t(7), 3.5, 2, 2, 0), ("run2", "taskfile1", t(1), 1.0, 1, 0, 1), ("run3", "taskfile2", t(0), 3.0, 1, 1, 0)]
    tasks = [
        (1, "run1", "taskfile1", "task1", "sig1", "srv01", "proc1", "Success", t(7), t(7, 1.5), 1.5, 0, None),
        (2, "run1", "taskfile1", "task2", "sig2", "srv01", "proc2", "Success", t(7, 1.5), t(7, 3.5), 2.0, 0, None),
        (3, "run2", "taskfile1", "task1", "sig1", "srv01", "proc1", "Fail", t(1), t(1, 1), 1.0, 1, "Error message"),
        (4, "run3", "taskfile2", "task1", "sig3", "srv02", "proc3", "Success", t(0), t(0, 3), 3.0, 0, None)]
    r = spark.createDataFrame(runs, "run_id string, workflow string, start_time timestamp, duration_seconds double, task_count int, success_count int, failure_count int")
    k = spark.createDataFrame(tasks, "id long, run_id string, workflow string, task_id string, task_signature string, instance string, process string, status string, start_time timestamp, end_time timestamp, duration_seconds double, retry_count int, error_message string")
    return conform(r, RUNS), conform(k, TASKS)


def test_totals(seed):
    _, tasks = seed
    t = h.history_stats(tasks).first()
    assert (t["total_records"], t["workflow_count"], t["run_count"], t["unique_tasks"], t["success_rate"]) == (4, 2, 3, 3, 75.0)
    s = h.workflow_stats(tasks).filter("workflow = 'taskfile1'").first()
    assert (s["total_records"], s["run_count"], s["unique_tasks"], s["avg_duration"], s["max_duration"]) == (3, 2, 2, 1.75, 2.0)
    assert [r["workflow"] for r in h.list_workflows(tasks).collect()] == ["taskfile2", "taskfile1"]


def test_list_runs_and_tasks(seed):
    runs, tasks = seed
    got = h.list_runs(runs, tasks).filter("workflow = 'taskfile1'").orderBy(F.desc("start_time")).collect()
    assert [(r["run_id"], r["task_count"], r["success_rate"], r["total_task_duration"]) for r in got] == [("run2", 1, 0.0, 1.0), ("run1", 2, 100.0, 3.5)]
    assert rows(h.list_runs(runs, tasks, limit=1), "run_id") == [("run2",), ("run3",)]
    bare = runs.withColumn("task_count", F.lit(None).cast("int")).withColumn("success_count", F.lit(None).cast("int"))
    assert rows(h.list_runs(bare, tasks), "run_id", "task_count", "success_count") == [("run1", 2, 2), ("run2", 1, 0), ("run3", 1, 1)]
    assert h.list_tasks(tasks).filter("workflow = 'taskfile1'").count() == 2


def test_deletes(seed):
    runs, tasks = seed
    assert rows(h.purge(tasks, workflow="taskfile1"), "id") == [(4,)]
    assert h.purge_count(tasks, workflow="taskfile1").first()["n"] == 3
    assert rows(h.purge(tasks, run_id="run1"), "id") == [(3,), (4,)]
    assert rows(h.purge(tasks, before=NOW - timedelta(days=2)), "id") == [(3,), (4,)]
    assert h.purge(tasks).count() == 0 and h.purge_count(tasks).first()["n"] == 4
    kept, left, gone = h.retain(runs, tasks, 3, NOW)
    assert (rows(kept, "run_id"), rows(left, "id"), rows(gone, "run_id")) == ([("run2",), ("run3",)], [(3,), (4,)], [("run1",)])
    kept, left, gone = h.retain(runs, tasks, 0, NOW)
    assert (kept.count(), left.count(), gone.count()) == (3, 4, 0)


def test_run_details_without_header(seed):
    runs, tasks = seed
    got = j.run_details(runs.filter("run_id <> 'run1'"), tasks).filter("run_id = 'run1'").first()
    assert (got["workflow"], got["duration_seconds"], got["task_count"], got["success_rate"], got["total_task_duration"], got["has_header"]) == ("taskfile1", None, 2, 100.0, 3.5, False)


def _run(spark, durations, status="Success"):
    runs = conform(spark.createDataFrame([("r", "wf")], "run_id string, workflow string"), RUNS)
    tasks = conform(spark.createDataFrame([("r", status, float(d), i) for i, d in enumerate(durations)] or [("other", "Success", 1.0, 0)],
                                          "run_id string, status string, duration_seconds double, id long"), TASKS)
    return h.run_distribution(runs, tasks).filter("run_id = 'r'").first().asDict()


def test_run_distribution(spark):
    got = _run(spark, [1, 2, 3, 4, 5])
    assert (got["min"], got["median"], got["mean"], got["max"], got["q1"], got["q3"], got["std_dev"]) == (1, 3, 3, 5, 2, 4, 1.58)
    assert set(_run(spark, []).values()) == {"r", 0}
    assert set(_run(spark, [4, 5], "Fail").values()) == {"r", 0}
    one = _run(spark, [7.5])
    assert (one["min"], one["q1"], one["median"], one["q3"], one["max"], one["std_dev"]) == (7.5, 7.5, 7.5, 7.5, 7.5, 0)
    assert _run(spark, [1, 1, 1, 1, 1, 1, 50])["outlier_count"] == 1


def test_timeline(spark):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    runs = conform(spark.createDataFrame([("r", t0, 10.0), ("empty", t0, 3.0)], "run_id string, start_time timestamp, duration_seconds double"), RUNS)
    tasks = conform(spark.createDataFrame([("r", at(1), at(4)), ("r", at(2.5), at(20))], "run_id string, start_time timestamp, end_time timestamp"), TASKS)
    got = sorted(tuple(r) for r in w.concurrency_timeline(runs, tasks).collect())
    assert got == [("empty", 0, 3, 0), ("r", 0, 0, 0), ("r", 1, 2, 1), ("r", 3, 3, 2), ("r", 4, 10, 1)]
    long = runs.withColumn("duration_seconds", F.lit(90_000.0))
    assert sorted(tuple(r) for r in w.concurrency_timeline(long, tasks).collect())[-2:] == [("r", 4, 19, 1), ("r", 20, 90_000, 0)]


def test_renumber(spark):
    def run(ids, starts=None):
        data = [("r", str(t), i, datetime(2024, 1, 1) + timedelta(seconds=(starts or range(len(ids)))[i])) for i, t in enumerate(ids)]
        df = conform(spark.createDataFrame(data, "run_id string, task_id string, id long, start_time timestamp"), TASKS)
        return [(r["original_task_id"], r["task_id"]) for r in w.renumber_results(df).orderBy(F.col("task_id").cast("int")).collect()]
    assert run([1, 2, 2, 2, 3]) == [("1", "1"), ("2", "2"), ("2", "3"), ("2", "4"), ("3", "5")]
    assert [x[1] for x in run([1, 2, 2, 3, 4, 4, 4])] == [str(i) for i in range(1, 8)]
    assert [x[0] for x in run([10, 2, 1])] == ["1", "2", "10"]
    assert [x[0] for x in run([2, "b", 1])] == ["1", "2", "b"]


def test_expanded_summary(spark):
    t = datetime(2024, 1, 1)
    data = [(1, "r", "1", "Success", t, t + timedelta(seconds=2), 2.0, 0, None, {"a": "1"}),
            (2, "r", "2", "Success", t, t + timedelta(seconds=2), 2.0, 1, None, {"a": "1"}),
            (3, "r", "2", "Fail", t + timedelta(seconds=1), t + timedelta(seconds=5), 4.0, 2, "boom", {"a": "2"}),
            (4, "r", "3", "Fail", t, t, 0.0, 0, "x", {}), (5, "r", "3", "Fail", t, t, 0.0, 0, "y", {})]
    df = conform(spark.createDataFrame(data, "id long, run_id string, task_id string, status string, start_time timestamp, end_time timestamp, duration_seconds double, retry_count int, error_message string, parameters map<string,string>"), TASKS)
    got = {r["task_id"]: r for r in h.expanded_summary(df).collect()}
    assert (got["1"]["status"], got["1"]["parameters"], got["1"]["instances"]) == ("Success", '{"a": "1"}', 1)
    assert (got["2"]["status"], got["2"]["duration_seconds"], got["2"]["retry_count"], got["2"]["error_message"]) == ("Partial (1/2 Success)", 5.0, 3, "boom")
    assert (got["2"]["parameters"], got["2"]["id"]) == ('{"expanded": 2}', 2) and set(TASKS.fieldNames()) <= set(got["1"].asDict())
    assert (got["3"]["status"], got["3"]["error_message"]) == ("Fail", "x")
    details = sorted(tuple(r) for r in h.expanded_details(df).collect())
    assert details == [("r", "1", 1, '{"a": "1"}', ""), ("r", "2", 1, '{"a": "1"}', ""), ("r", "2", 2, '{"a": "2"}', "boom"),
                       ("r", "3", 1, "{}", "x"), ("r", "3", 2, "{}", "y")]
    # The grain does not depend on how many instances there are.
    many = spark.range(2500).select("id", F.lit("r").alias("run_id"), F.lit("9").alias("task_id"), F.lit("Success").alias("status"),
                                    F.lit(t).alias("start_time"), F.lit(t).alias("end_time"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("parameters"))
    assert [r["instances"] for r in h.expanded_summary(conform(many, TASKS)).collect()] == [2500]
    assert sorted(r["instance_no"] for r in h.expanded_details(conform(many, TASKS)).collect()) == list(range(1, 2501))


def test_search_and_selection(seed):
    runs, tasks = seed
    p = tasks.withColumn("parameters", F.create_map(F.lit("pRegion"), F.lit("North"))).withColumn("stage", F.when(F.col("id") < 3, "load"))
    assert rows(h.search_tasks(p, "NORTH", ("load",)), "id") == [(3,), (4,)]
    assert rows(h.search_tasks(p, "proc3"), "id") == [(4,)]
    wanted = runs.select(F.upper("workflow").alias("workflow")).unionByName(runs.limit(1).select(F.lit("Nope").alias("workflow")))
    got = {r["workflow"]: (r["run_count"], r["error"]) for r in h.select_workflow(runs, wanted).collect()}
    assert got["taskfile1"] == (2, None) and got["nope"][0] == 0 and "nope" in got["nope"][1]


def test_order_ready(spark):
    est = spark.createDataFrame([("r", 0, 5.0), ("r", 1, 20.0), ("r", 2, 5.0), ("r", 3, 10.0)], "run_id string, pos int, estimate double")
    longest = w.order_ready(est, ["run_id"]).orderBy("dispatch_order").collect()
    assert [r["pos"] for r in longest] == [1, 3, 0, 2]
    shortest = w.order_ready(est, ["run_id"], longest_first=False).orderBy("dispatch_order").collect()
    assert [r["pos"] for r in shortest] == [0, 2, 3, 1]


def test_complete_run(seed):
    runs, tasks = seed
    raised = runs.filter("run_id in ('run1', 'run2')").select("run_id")
    got = {r["run_id"]: r for r in j.complete_run(runs, tasks, raised).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"run1": "Partial", "run2": "Failed", "run3": "Success"}
    assert got["run1"]["duration_seconds"] == 3.5 and got["run1"]["success_count"] == 2


def test_states_equal_the_full_scan_after_each_append(spark, seed, tmp_path):
    """Batches in any cut, with nulls, an empty one and a run that goes on over two, give what a scan of the history gives."""
    _, tasks = seed
    more = tasks.where("id = 3").withColumn("id", F.lit(9).cast("long")).withColumn("duration_seconds", F.lit(None).cast("double"))
    blank = tasks.where("id = 4").withColumn("workflow", F.lit(None).cast("string")).withColumn("task_signature", F.lit(None).cast("string"))
    seen, path = tasks.limit(0), str(tmp_path / "states")
    for batch in (tasks.limit(0), tasks.where("id % 2 = 1"), tasks.where("id % 2 = 0"), more, blank):
        summaries.append_state(batch, path)
        seen = seen.unionByName(batch)
        state = summaries.read_states(spark, path)
        assert rows(summaries.history_stats(state)) == rows(h.history_stats(seen))
        assert rows(summaries.workflow_stats(state)) == rows(h.workflow_stats(seen))
    twice = summaries.merged(summaries.merged(summaries.states(tasks.where("id < 3"))).unionByName(summaries.states(tasks.where("id >= 3"))))
    assert rows(summaries.history_stats(twice)) == rows(h.history_stats(tasks))
