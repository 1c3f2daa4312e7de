from __future__ import annotations

import json
import os
from datetime import datetime

from pyspark.sql import functions as F

from runtally.operators import joins as j
from runtally.schemas import CELLS, RUNS, TASKS, UPLOAD_COLUMNS, conform
from runtally.sources import readers, writers
from tests.conftest import rows

DOC = {
    "version": "2.0", "metadata": {"workflow": "daily", "author": "me"},
    "settings": {"max_workers": 4, "stage_order": ["extract", "load"], "stage_workers": {"extract": 2}},
    "tasks": [
        {"id": 1, "instance": "srv", "process": "p1", "parameters": {"pYear": "2024", "pN": 5}, "predecessors": []},
        {"id": "2", "instance": "srv", "chore": "nightly", "process": "", "predecessors": [1], "stage": "load", "safe_retry": True},
        {"id": "3", "instance": "srv", "process": "p3", "predecessors": ["1", "2"], "timeout": 60, "require_predecessor_success": True, "parameters": {"q": "é\"x"}}],
}


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_taskfiles(spark, tmp_path):
    write(f"{tmp_path}/archive/daily/run1.json", json.dumps(DOC, indent=2))
    write(f"{tmp_path}/archive/other/run2.json", json.dumps({"tasks": [{"id": "9", "instance": "s", "process": "p"}]}))
    files, defs = readers.read_taskfiles(spark, f"{tmp_path}/archive/*/*.json")
    f = {r["workflow"]: r for r in files.collect()}
    assert (f["daily"]["run_id"], f["daily"]["max_workers"], f["daily"]["stage_order"], f["daily"]["stage_workers"]) == ("run1", 4, ["extract", "load"], {"extract": 2})
    assert f["other"]["version"] is None and f["other"]["run_id"] == "run2"
    d = {r["id"]: r for r in defs.filter("workflow = 'daily'").collect()}
    assert d["1"]["parameters"] == {"pYear": "2024", "pN": "5"} and d["1"]["predecessors"] == []
    assert (d["2"]["process"], d["2"]["chore"], d["2"]["predecessors"], d["2"]["safe_retry"], d["2"]["parameters"]) == (None, "nightly", ["1"], True, {})
    assert (d["3"]["timeout"], d["3"]["require_predecessor_success"], d["3"]["cancel_at_timeout"], d["3"]["pos"]) == (60, True, False, 2)


def test_taskfile_round_trip(spark, tmp_path):
    write(f"{tmp_path}/in/daily/run1.json", json.dumps(DOC))
    _, defs = readers.read_taskfiles(spark, f"{tmp_path}/in/*/*.json")
    text = "".join(r["text"] for r in writers.taskfile_lines(defs).orderBy("line").collect())
    doc = json.loads(text)
    assert doc["version"] == "2.0" and doc["metadata"]["workflow"] == "daily"
    assert doc["tasks"] == [
        {"id": "1", "instance": "srv", "process": "p1", "parameters": {"pYear": "2024", "pN": "5"}},
        {"id": "2", "instance": "srv", "chore": "nightly", "predecessors": ["1"], "stage": "load", "safe_retry": True},
        {"id": "3", "instance": "srv", "process": "p3", "parameters": {"q": "é\"x"}, "predecessors": ["1", "2"], "timeout": 60, "require_predecessor_success": True}]
    settings = spark.createDataFrame([("daily", '{"max_workers": 7}')], "workflow string, settings_json string")
    writers.write_taskfiles(defs, f"{tmp_path}/out", settings)
    folder = f"{tmp_path}/out/workflow=daily"
    back = "".join(open(f"{folder}/{n}", encoding="utf-8").read() for n in sorted(os.listdir(folder)) if n.startswith("part"))
    assert json.loads(back)["settings"] == {"max_workers": 7}


OPT = '''# a comment

id="1" predecessors="" require_predecessor_success="False" instance="srv" process="p one" pDir="D:\\stock\\in\\" pX=1
id="2" predecessors="1" require_predecessor_success="yes" instance="srv" process="p2" timeout="30" Safe_Retry="TRUE" stage=""
id="3" predecessors="1,2" instance="srv" chore="nightly"
id="4" instance="broken
'''
NORM = '''instance="srv" process="a"
instance="srv" process="b" pK="1"
WAIT
instance="srv" process="c"
wait
wait
instance="srv" process="d"
'''


def test_line_files(spark, tmp_path):
    write(f"{tmp_path}/opt.txt", OPT)
    write(f"{tmp_path}/norm.txt", NORM)
    lines = readers.read_lines(spark, f"{tmp_path}/*.txt")
    nos = lines.filter(F.col("file").endswith("norm.txt")).orderBy("line_no").collect()
    assert [r["line_no"] for r in nos] == list(range(1, 8)) and nos[2]["value"] == "WAIT"
    mode = {os.path.basename(r["file"]): (r["file_type"], r["mode"]) for r in readers.detect_line_mode(lines).collect()}
    assert mode == {"opt.txt": ("txt", "opt"), "norm.txt": ("txt", "norm")}
    t = {(r["workflow"], r["id"]): r for r in readers.parse_task_lines(lines).collect()}
    assert set(t) == {("opt", "1"), ("opt", "2"), ("opt", "3"), ("norm", "1"), ("norm", "2"), ("norm", "3"), ("norm", "4")}
    one, two, three = (t[("opt", i)] for i in "123")
    assert (one["process"], one["parameters"], one["predecessors"]) == ("p one", {"pDir": "D:\\stock\\in\\", "pX": "1"}, [])
    assert (two["predecessors"], two["require_predecessor_success"], two["timeout"], two["safe_retry"], two["stage"]) == (["1"], True, 30, True, None)
    assert (three["predecessors"], three["chore"], three["process"]) == (["1", "2"], "nightly", None)
    norm = {r["process"]: (r["sequence"], r["previous"], r["previous_size"]) for k, r in t.items() if k[0] == "norm"}
    assert norm == {"a": (0, None, None), "b": (0, None, None), "c": (1, 0, 2), "d": (3, None, None)}


def test_line_mode_errors(spark):
    lines = spark.createDataFrame([("e.txt", 1, "# nothing"), ("u.txt", 1, "process=x"), ("j", 1, "{"), ("n.txt", 2, "wait"), ("n.txt", 1, " ")], "file string, line_no int, value string")
    got = {r["file"]: (r["file_type"], r["mode"], r["error"]) for r in readers.detect_line_mode(lines).collect()}
    assert got["e.txt"] == ("txt", None, "file contains no task definitions")
    assert got["u.txt"][2].startswith("Cannot determine") and got["j"] == ("json", None, None) and got["n.txt"][1] == "norm"


def test_checkpoints(spark, tmp_path):
    good = {"version": "1.0", "taskfile_path": "t.json", "workflow": "w", "taskfile_hash": "h", "run_started": "x", "checkpoint_created": "y", "total_tasks": 4,
            "completed_tasks": {"1": {"task_id": "1", "success": True, "duration_seconds": 1.5, "retry_count": 0}, "2": {"task_id": "2", "success": False, "error_message": "no"}},
            "in_progress_tasks": ["3"], "pending_tasks": ["4"], "failed_tasks": ["2"], "skipped_tasks": []}
    write(f"{tmp_path}/c/checkpoint_w.json", json.dumps(good, indent=1))
    write(f"{tmp_path}/c/checkpoint_bad.json", json.dumps({"taskfile_path": "t", "workflow": "w"}))
    state, bad = readers.read_checkpoints(spark, f"{tmp_path}/c/*.json")
    assert rows(state, "task_id", "state", "success") == [("1", "completed", True), ("2", "completed", False), ("2", "failed", None), ("3", "in_progress", None), ("4", "pending", None)]
    assert bad.first()["error"].endswith("run_started")
    from runtally.operators.history import checkpoint_progress
    p = checkpoint_progress(state).first()
    assert (p["completed"], p["failed"], p["success_count"], p["progress_percentage"], p["is_complete"]) == (2, 1, 1, 50.0, False)
    write(f"{tmp_path}/tasks/a.json", "content")
    import hashlib
    assert readers.file_hashes(spark, f"{tmp_path}/tasks").first()["current_hash"] == hashlib.sha256(b"content").hexdigest()


def test_stored_rows(spark, tmp_path):
    old = spark.createDataFrame([(1, "r", "w", "t", '{"a": "1"}', '["1", "2"]', 1, "2024-01-01T10:00:00", "2024-01-01T10:00:01.500000"), (2, "r", "w", "u", None, None, None, None, None)],
                                "id long, run_id string, workflow string, task_id string, parameters string, predecessors string, safe_retry int, start_time string, end_time string")
    got = {r["id"]: r for r in readers.decode_tasks(old).collect()}
    assert got[1]["parameters"] == {"a": "1"} and got[1]["predecessors"] == ["1", "2"] and got[1]["safe_retry"] is True
    assert got[1]["end_time"] == datetime(2024, 1, 1, 10, 0, 1, 500000)
    assert got[2]["parameters"] == {} and got[2]["predecessors"] is None and got[2]["safe_retry"] is None and got[2]["chore"] is None
    item = spark.createDataFrame([("1", "r", "12.5", "abc", None), ("2", "r", "oops", "3", "{}")], "id string, run_id string, duration_seconds string, retry_count string, parameters string")
    got = rows(readers.normalise_items(item), "id", "duration_seconds", "retry_count")
    assert got == [(1, 12.5, 0), (2, None, 3)]


def test_record_and_append(spark, tmp_path):
    t = datetime(2024, 1, 1)
    raw = spark.createDataFrame([("r", "w1", "1", "srv", "p", {"a": "1"}, True, t, datetime(2024, 1, 1, 0, 0, 1, 234567), "noise", ["1"]),
                                 ("r", "w2", "2", "srv", "p", None, False, t, t, "boom", [])],
                                "run_id string, workflow string, task_id string, instance string, process string, parameters map<string,string>, success boolean, start_time timestamp, end_time timestamp, error_message string, predecessors array<string>") \
        .withColumn("chore", F.lit(None).cast("string")).withColumn("retry_count", F.lit(None).cast("int"))
    writers.append_history(writers.record_tasks(raw), f"{tmp_path}/h")
    writers.append_history(writers.record_tasks(raw.filter("task_id = '1'")), f"{tmp_path}/h")
    assert sorted(n for n in os.listdir(f"{tmp_path}/h") if n.startswith("workflow")) == ["workflow=w1", "workflow=w2"]
    got = readers.read_task_results(spark, f"{tmp_path}/h")
    assert got.schema.fieldNames() == TASKS.fieldNames()
    assert rows(got, "task_id", "status", "duration_seconds", "error_message", "retry_count", "predecessors") == [
        ("1", "Success", 1.235, None, 0, ["1"]), ("1", "Success", 1.235, None, 0, ["1"]), ("2", "Fail", 0.0, "boom", 0, None)]
    plan = got.filter("workflow = 'w1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workflow" in plan


def test_results_file(spark, tmp_path):
    df = conform(spark.createDataFrame([(1, "r", "w", "1", "srv", "p", {"k": 'a "b"'}, "Success", 2.5, 300)],
                                       "id long, run_id string, workflow string, task_id string, instance string, process string, parameters map<string,string>, status string, duration_seconds double, timeout int"), TASKS)
    out = writers.export_results(df, workflow="w", run_id="r")
    assert out.columns[0] == "run_id" and "workflow" not in out.columns
    writers.write_csv(out, f"{tmp_path}/csv")
    import csv
    import glob
    text = [list(csv.DictReader(open(f, encoding="utf-8"))) for f in glob.glob(f"{tmp_path}/csv/part*.csv")]
    row = next(r[0] for r in text if r)
    assert row["parameters"] == '{"k": "a \\"b\\""}' and row["original_task_id"] == "1" and row["timeout"] == "300" and row["safe_retry"] == "false"
    assert writers.export_results(df, workflow="x").count() == 0
    up = writers.upload_payload(df)
    assert tuple(up.columns) == UPLOAD_COLUMNS and up.first()["parameters"] == 'k="a "b""'


def test_cells(spark):
    cells = spark.createDataFrame([("w", "Input", "1", "instance", "srv"), ("w", "Input", "1", "process", "p"), ("w", "Input", "1", "parameters", "a=1 b=\"x y\""),
                                   ("w", "Input", "2", "wait", "true"), ("w", "Input", "3", "instance", "srv"), ("w", "Input", "3", "chore", "c"), ("w", "Input", "3", "predecessors", "1, 2"),
                                   ("w", "Input", "4", "instance", "srv"), ("w", "Input", "5", "instance", "s"), ("w", "Input", "5", "process", "p"), ("w", "Input", "5", "chore", "c"),
                                   ("w", "Input", "6", "stage", ""), ("w", "20240101", "9", "instance", "srv"), ("w", "Input", "7", "status", "x")], CELLS)
    wide = readers.cells_to_tasks(cells)
    assert rows(wide, "task_id") == [(str(i),) for i in (1, 2, 3, 4, 5)]
    wide = wide.withColumn("pos", F.col("task_id").cast("long"))
    norm, err = readers.tasks_from_wide(wide, "norm")
    got = {r["id"]: r for r in norm.collect()}
    assert set(got) == {"1", "3"} and got["1"]["parameters"] == {"a": "1", "b": "x y"} and got["3"]["previous"] == 0 and got["3"]["predecessors"] == []
    assert rows(err, "task_id") == [("5",)]
    opt, _ = readers.tasks_from_wide(wide, "opt")
    assert {r["id"]: r["predecessors"] for r in opt.collect()} == {"1": [], "3": ["1", "2"]}
    assert ("wait",) not in rows(j.input_measures(cells, "opt")) and ("wait",) in rows(j.input_measures(cells, "norm"))
    assert ("status",) in rows(j.result_measures(cells))


def test_last_row_wins_in_cells(spark):
    df = conform(spark.createDataFrame([(1, "r", "w", "1", "Fail"), (2, "r", "w", "1", "Success")], "id long, run_id string, workflow string, task_id string, status string"), TASKS)
    cells = writers.results_to_cells(writers.results_table(df, keep=("id",)))
    assert rows(cells.filter("measure = 'status'"), "value") == [("Success",)] and cells.groupBy("measure").count().filter("count > 1").count() == 0


def test_start_run_keeps_flags(spark):
    h = spark.createDataFrame([("r", "w", True, None, "Success")], "run_id string, workflow string, exclusive boolean, optimize boolean, status string")
    got = writers.start_run(h).first()
    assert (got["exclusive"], got["optimize"], got["status"]) == (True, None, None) and writers.start_run(h).schema.fieldNames() == RUNS.fieldNames()


def test_upsert(spark):
    dim = spark.createDataFrame([("a",), ("b",)], "member string")
    new = spark.createDataFrame([("b",), ("c",), ("c",)], "member string")
    assert rows(j.upsert_members(dim, new)) == [("a", False), ("b", False), ("c", True)]


def test_items_without_id(spark, tmp_path):
    from runtally.operators import history
    def item(second, task, tail, process, status="Success"):
        start = f"2024-01-01T00:00:0{second}.000000"
        return {"run_id": "r", "task_result_id": f"{start}#{task}#{tail}", "workflow": "w", "task_id": task, "task_signature": "s", "instance": "srv", "process": process,
                "status": status, "start_time": start, "duration_seconds": "1.5", "parameters": "{}"}
    items = [item(2, "1", "aa", "late"), item(1, "2", "bb", "b"), item(1, "1", "dd", "d", "Fail"), item(1, "1", "cc", "c")]
    write(f"{tmp_path}/items.json", "\n".join(json.dumps(x) for x in items))
    got = readers.read_items(spark, f"{tmp_path}/items.json")
    assert sorted(r["task_result_id"] for r in got.collect()) == sorted(x["task_result_id"] for x in items)
    every = readers.union_sources([got.limit(0), got])
    assert rows(history.list_tasks(every), "task_id", "instance", "process", "run_count") == [("1", "srv", "c", 4)]
    assert rows(history.task_summaries(every), "task_id", "instance", "process", "executions") == [("1", "srv", "c", 4)]
    cells = writers.results_to_cells(writers.results_table(every, keep=("id", "task_result_id")))
    assert rows(cells.filter("measure = 'process'"), "task_id", "value") == [("1", "late"), ("2", "b")]
    same = every.filter("start_time < '2024-01-01 00:00:02'")
    cells = writers.results_to_cells(writers.results_table(same, keep=("id", "task_result_id")))
    assert rows(cells.filter("measure in ('process', 'status') and task_id = '1'"), "measure", "value") == [("process", "d"), ("status", "Fail")]


def test_line_numbers_of_split_files(spark, tmp_path):
    """Files cut into many splits, some within a line, are numbered as they stand, without a sort of their text."""
    texts = {"a.txt": [f"line {i} " + "x" * (i % 90) for i in range(3000)], "b.txt": ["", "only", ""], "c.txt": ["y" * 40_000, "end"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = readers.read_lines(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 10
        got = {}
        for r in df.collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line_no"]] = r["value"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {name: dict(enumerate(lines, 1)) for name, lines in texts.items()}
