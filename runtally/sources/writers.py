"""Builders of rows to append and writers of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from runtally.functions.scalars import (empty_map, json_map, json_string, json_strings, render_params, rounded,
                                        seconds_between, success, task_signature)
from runtally.operators.history import zero_if_null
from runtally.operators.ordered import match
from runtally.schemas import MEASURES, RUNS, TASK_KEY, TASKFILE_VERSION, TASKS, UPLOAD_COLUMNS, conform

FLAGS = ("safe_retry", "cancel_at_timeout", "require_predecessor_success", "succeed_on_minor_errors")


def record_tasks(raw: DataFrame) -> DataFrame:
    """Execution records (``success`` flag, times, definition) to task-result rows."""
    params = F.coalesce("parameters", empty_map())
    good = F.coalesce(F.col("success"), F.lit(False))
    new = raw.withColumn("parameters", params) \
        .withColumn("task_signature", task_signature("instance", "process", "parameters", "chore")) \
        .withColumn("status", F.when(good, "Success").otherwise("Fail")) \
        .withColumn("duration_seconds", rounded(seconds_between("start_time", "end_time"), 3)) \
        .withColumn("error_message", F.when(~good, F.col("error_message"))) \
        .withColumn("retry_count", F.coalesce("retry_count", F.lit(0))) \
        .withColumn("predecessors", F.when(F.size("predecessors") > 0, F.col("predecessors")))
    return conform(new, TASKS)


def start_run(headers: DataFrame) -> DataFrame:
    """New run headers: settings kept, outcome still unknown."""
    open_ = ("end_time", "duration_seconds", "status", "success_count", "failure_count")
    return conform(headers.drop(*open_), RUNS)


def _laid_out(rows: DataFrame) -> DataFrame:
    """Rows placed for a table partitioned by workflow and sorted by run.

    The rebalance hint lets the runtime split a workflow that holds most rows and merge
    small ones, so files are neither huge nor many; the sort makes the minimum and maximum
    of a file's row groups useful for look-ups by run.
    """
    return rows.hint("rebalance", "workflow").sortWithinPartitions("workflow", "run_id")


def append_history(rows: DataFrame, path: str) -> None:
    _laid_out(rows).write.mode("append").partitionBy("workflow").parquet(path)


def replace_history(rows: DataFrame, path: str) -> None:
    _laid_out(rows).write.mode("overwrite").partitionBy("workflow").parquet(path)


def results_table(tasks: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Result rows with the names and defaults of the results file; ``keep`` adds columns."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    retries = F.coalesce("retry_count", F.lit(0))
    timeout = F.when(F.col("timeout") != 0, F.col("timeout").cast("string"))
    return tasks.select(
        "workflow", "run_id", "task_id", F.col("task_id").alias("original_task_id"), text("instance"),
        text("process"), text("chore"), json_map("parameters").alias("parameters"), text("status"),
        "start_time", "end_time", F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"),
        retries.alias("retries"), retries.alias("retry_count"), text("error_message"),
        F.coalesce(json_strings("predecessors"), F.lit("")).alias("predecessors"), text("stage"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAGS[:1]],
        F.coalesce(timeout, F.lit("")).alias("timeout"),
        *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in FLAGS[1:]], *keep)


def export_results(tasks: DataFrame, workflow: str | None = None, run_id: str | None = None) -> DataFrame:
    """Results of one run, one workflow or all, ``run_id`` first."""
    t = tasks
    if workflow is not None:
        t = t.filter(F.col("workflow") == workflow)
    if run_id is not None:
        t = t.filter(F.col("run_id") == run_id)
    out = results_table(t).drop("workflow")
    return out.select("run_id", *[c for c in out.columns if c != "run_id"])


def export_history(tasks: DataFrame, workflow: str | None = None, run_id: str | None = None) -> DataFrame:
    """All columns as text-friendly values, by start time and task."""
    t = tasks
    if workflow is not None:
        t = t.filter(F.col("workflow") == workflow)
    if run_id is not None:
        t = t.filter(F.col("run_id") == run_id)
    return t.withColumn("parameters", json_map("parameters")) \
        .withColumn("predecessors", json_strings("predecessors")).orderBy("start_time", "task_id")


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep) \
        .option("escape", '"').csv(path)


def results_to_cells(results: DataFrame, order: str = "id") -> DataFrame:
    """Wide results to cells; of several rows of a task the last one counts, by ``order``, then start and key."""
    names = [m for m, _, is_result in MEASURES if is_result]
    extra = [m for m in ("retries",) if m in results.columns]
    last = F.struct(*[c for c in dict.fromkeys([order, "start_time", TASK_KEY]) if c in results.columns or c == order])
    wide = results.select("workflow", "run_id", "task_id", last.alias("_last"),
                          *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in [*names, *extra]])
    row = F.struct(*names, *extra)
    last = wide.groupBy("workflow", "run_id", "task_id").agg(F.max_by(row, "_last").alias("r")) \
        .select("workflow", "run_id", "task_id", "r.*")
    return last.unpivot(["workflow", "run_id", "task_id"], [*names, *extra], "measure", "value")


def run_summary(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """One record per run: executions, failures, times, overall success."""
    seen = tasks.groupBy("run_id").agg(
        F.count("*").alias("process_runs"), F.count_if(~success()).alias("process_fails"))
    return runs.join(seen, "run_id", "left").select(
        "run_id", F.coalesce("process_runs", F.lit(0)).alias("process_runs"),
        F.coalesce("process_fails", F.lit(0)).alias("process_fails"),
        F.col("start_time").alias("start"), F.col("end_time").alias("end"),
        rounded(seconds_between("start_time", "end_time"), 6).alias("runtime"),
        (F.coalesce("process_fails", F.lit(0)) == 0).alias("overall_success"))


def upload_payload(tasks: DataFrame) -> DataFrame:
    """Results in the loader's column order with parameters as the user writes them."""
    params = render_params(F.from_json("parameters", "map<string,string>"))
    return results_table(tasks).withColumn("parameters", params).select(*UPLOAD_COLUMNS)


def task_json() -> Column:
    """One definition as JSON; fields with their default value are left out."""
    def field(name: str, cond: Column, value: Column) -> Column:
        return F.when(cond, F.concat(F.lit(f'"{name}": '), value))

    def text(name: str, always: bool = False) -> Column:
        cond = F.lit(True) if always else F.coalesce(F.col(name), F.lit("")) != ""
        return field(name, cond, json_string(F.coalesce(name, F.lit(""))))

    flag = lambda n: field(n, F.coalesce(F.col(n), F.lit(False)), F.lit("true"))
    parts = [
        text("id", True), text("instance", True), text("process"), text("chore"),
        field("parameters", F.coalesce(F.size("parameters"), F.lit(0)) > 0, json_map("parameters")),
        field("predecessors", F.coalesce(F.size("predecessors"), F.lit(0)) > 0, json_strings("predecessors")),
        text("stage"), flag("safe_retry"),
        field("timeout", F.col("timeout").isNotNull(), F.col("timeout").cast("string")),
        flag("cancel_at_timeout"), flag("require_predecessor_success"), flag("succeed_on_minor_errors")]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def taskfile_lines(defs: DataFrame, settings: DataFrame | None = None,
                   key: str = "workflow") -> DataFrame:
    """Task documents as lines ``(workflow, line, text)``; joined in order they are JSON.

    A document of any size is a run of lines, so no document has to fit one row.
    ``settings(workflow, settings_json)`` is optional.
    """
    ends = defs.groupBy(key).agg(F.max("pos").alias("_last"), F.count("*").alias("tasks"))
    heads = ends.select(key, "_last") if settings is None else match(ends.select(key, "_last"), settings, [key], "left")
    doc = F.lit("{}") if settings is None else F.coalesce("settings_json", F.lit("{}"))
    head = F.concat(F.lit(f'{{"version": "{TASKFILE_VERSION}", "metadata": {{"workflow": '), json_string(key),
                    F.lit('}, "settings": '), doc, F.lit(', "tasks": ['))
    first = heads.select(key, F.lit(-1).cast("long").alias("line"), head.alias("text"))
    last = ends.select(key, (F.col("_last") + 1).cast("long").alias("line"), F.lit("]}").alias("text"))
    body = match(defs, ends.select(key, "_last"), [key]).select(
        key, F.col("pos").cast("long").alias("line"),
        F.concat(task_json(), F.when(F.col("pos") < F.col("_last"), ",").otherwise("")).alias("text"))
    return first.unionByName(body).unionByName(last)


def write_taskfiles(defs: DataFrame, path: str, settings: DataFrame | None = None) -> None:
    """One folder per workflow; its part files in name order make the document."""
    taskfile_lines(defs, settings).repartitionByRange("workflow", "line") \
        .sortWithinPartitions("workflow", "line").select("workflow", "text") \
        .write.mode("overwrite").partitionBy("workflow").text(path)

