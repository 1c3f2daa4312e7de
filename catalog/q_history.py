"""Sources, filters and aggregations over run history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog.registry import query, scratch
from catalog.tables import executions, results, runs
from runtally.functions.scalars import json_map
from runtally.operators import history as h, summaries
from runtally.schemas import RUNS, TASKS
from runtally.sources import commits, readers, writers

NOW = datetime(2024, 1, 31)
EX_COLS = """id, run_id, workflow, task_id, task_signature, instance, process, chore, status, start_time, end_time,
duration_seconds, retry_count, error_message, stage, safe_retry, timeout, cancel_at_timeout, require_predecessor_success, succeed_on_minor_errors"""
EX_LIST = [c.strip() for c in EX_COLS.replace("\n", " ").split(",")]


@query("read_runs", "SELECT * FROM runs", dbl="duration_seconds:3", ts="start_time,end_time")
def read_runs(spark, sf):
    path = scratch(spark)
    writers.replace_history(runs(spark, sf), path)
    return readers.read_runs(spark, path)


@query("read_task_results", f"SELECT {EX_COLS}, params, pred AS predecessors FROM ex", dbl="duration_seconds:3", ts="start_time,end_time")
def read_task_results(spark, sf):
    path = scratch(spark)
    as_stored = executions(spark, sf).withColumn("parameters", json_map("parameters"))
    for c in ("safe_retry", "cancel_at_timeout", "require_predecessor_success", "succeed_on_minor_errors"):
        as_stored = as_stored.withColumn(c, F.col(c).cast("int"))
    writers.append_history(as_stored.withColumn("predecessors", F.to_json("predecessors")), path)
    t = readers.decode_tasks(spark.read.parquet(path))
    return t.select(*EX_LIST, json_map("parameters").alias("params"), F.array_join("predecessors", ",").alias("predecessors"))


@query("schema_evolve", "SELECT run_id, workflow, status, CAST(NULL AS DOUBLE) AS duration_seconds, CAST(NULL AS VARCHAR) AS optimization_algorithm FROM runs")
def schema_evolve(spark, sf):
    old = runs(spark, sf).drop("duration_seconds", "optimization_algorithm")
    return readers.schema_evolve(old, RUNS).select("run_id", "workflow", "status", "duration_seconds", "optimization_algorithm")


def _item_key():
    """The key of an item of the document store; its last part, random there, holds the id here."""
    return F.concat_ws("#", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "task_id", F.hex("id")).alias("task_result_id")


def _id_of_key():
    return F.conv(F.substring_index("task_result_id", "#", -1), 16, 10).cast("long").alias("id")


@query("read_items", """SELECT id, run_id, task_id, task_signature, status, start_time, duration_seconds,
 CASE WHEN id % 5 = 0 THEN 0 ELSE retry_count END AS retry_count, CASE WHEN id % 7 = 0 THEN '{}' ELSE params END AS params FROM ex""",
       dbl="duration_seconds:3", ts="start_time")
def read_items(spark, sf):
    path = scratch(spark)
    items = executions(spark, sf).select(
        _item_key(), "run_id", "workflow", "task_id", "task_signature", "instance", "status",
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_time"),
        F.col("duration_seconds").cast("string").alias("duration_seconds"),
        F.when(F.col("id") % 5 != 0, F.col("retry_count").cast("string")).alias("retry_count"),
        F.when(F.col("id") % 7 != 0, F.to_json("parameters")).alias("parameters"))
    items.write.json(path)
    return readers.read_items(spark, path).select(
        _id_of_key(), "run_id", "task_id", "task_signature", "status", "start_time", "duration_seconds", "retry_count",
        json_map("parameters").alias("params"))


@query("task_target", "SELECT id, task_target, task_kind FROM ex")
def task_target(spark, sf):
    return h.with_target(executions(spark, sf)).select("id", "task_target", "task_kind")


@query("failures", """SELECT task_id, coalesce(process, '') AS process, coalesce(chore, '') AS chore, task_target, task_kind,
 instance, run_id, coalesce(duration_seconds, 0) AS duration, error_message FROM ex WHERE status <> 'Success'""", dbl="duration:2")
def failures(spark, sf):
    return h.failures(executions(spark, sf))


CUT = datetime(2024, 1, 11)


@query("retain", """SELECT 'run' AS kind, run_id, NULL AS id FROM runs WHERE start_time >= TIMESTAMP '2024-01-11'
 UNION ALL SELECT 'task', run_id, id FROM ex WHERE run_id IN (SELECT run_id FROM runs WHERE start_time >= TIMESTAMP '2024-01-11')
 UNION ALL SELECT 'dropped', run_id, NULL FROM runs WHERE start_time < TIMESTAMP '2024-01-11'""")
def retain(spark, sf):
    kept, tasks, gone = h.retain(runs(spark, sf), executions(spark, sf), 20, NOW)
    none = F.lit(None).cast("long").alias("id")
    return kept.select(F.lit("run").alias("kind"), "run_id", none) \
        .unionByName(tasks.select(F.lit("task").alias("kind"), "run_id", "id")) \
        .unionByName(gone.select(F.lit("dropped").alias("kind"), "run_id", none))


def _left(spark, sf, **kw):
    t = executions(spark, sf)
    return h.purge(t, **kw).groupBy("workflow", "run_id").agg(F.count("*").alias("left")) \
        .unionByName(h.purge_count(t, **kw).select(F.lit("dry run").alias("workflow"), F.lit(None).cast("string").alias("run_id"), F.col("n").alias("left")))


def _left_sql(cond):
    return f"""SELECT workflow, run_id, count(*) AS left FROM ex WHERE NOT ({cond}) GROUP BY workflow, run_id
 UNION ALL SELECT 'dry run', NULL, count(*) FROM ex WHERE {cond}"""


@query("purge_workflow", _left_sql("workflow = 'wf_2'"))
def purge_workflow(spark, sf):
    return _left(spark, sf, workflow="wf_2")


@query("purge_run", _left_sql("run_id = '20240105_1'"))
def purge_run(spark, sf):
    return _left(spark, sf, run_id="20240105_1")


@query("purge_before", _left_sql("start_time < TIMESTAMP '2024-01-11'"))
def purge_before(spark, sf):
    return _left(spark, sf, before=CUT)


@query("purge_all", _left_sql("true"))
def purge_all(spark, sf):
    return _left(spark, sf)


def _on_disk(rows):
    """A committed table of the rows, its folder and schema."""
    path = scratch(rows.sparkSession)
    commits.create(rows, path)
    return path, rows.schema


def _left_files(spark, sf, **kw):
    path, schema = _on_disk(executions(spark, sf))
    commits.purge_files(spark, path, schema, **kw)
    return commits.current(spark, path, schema).groupBy("workflow", "run_id").agg(F.count("*").alias("left"))


def _left_files_sql(cond):
    return f"SELECT workflow, run_id, count(*) AS left FROM ex WHERE NOT ({cond}) GROUP BY workflow, run_id"


@query("purge_run_files", _left_files_sql("run_id = '20240105_1'"))
def purge_run_files(spark, sf):
    return _left_files(spark, sf, run_id="20240105_1")


@query("purge_before_files", _left_files_sql("start_time < TIMESTAMP '2024-01-11'"))
def purge_before_files(spark, sf):
    return _left_files(spark, sf, before=CUT)


@query("complete_run_files", """WITH seen AS (SELECT run_id, max(end_time) AS last, min(start_time) AS first, count(*) AS n, count(*) FILTER (status = 'Success') AS good
   FROM ex WHERE workflow IN ('wf_1', 'wf_3') GROUP BY run_id)
 SELECT run_id, last AS end_time, CAST(epoch_us(last) - epoch_us(first) AS DOUBLE) / 1000000 AS duration_seconds,
 CASE WHEN n IS NOT NULL THEN 'Success' END AS status, good AS success_count, n - good AS failure_count FROM runs LEFT JOIN seen USING (run_id)""",
       dbl="duration_seconds:3", ts="end_time")
def complete_run_files(spark, sf):
    """Two workflows' runs are closed on disk; the others stay open."""
    path, schema = _on_disk(writers.start_run(runs(spark, sf)))
    done = executions(spark, sf).filter(F.col("workflow").isin("wf_1", "wf_3"))
    commits.complete_runs(spark, path, schema, done)
    return commits.current(spark, path, schema).select("run_id", "end_time", "duration_seconds", "status", "success_count", "failure_count")


@query("search_tasks", """SELECT id, task_id FROM ex WHERE coalesce(stage, '') <> 'load' AND
 contains(lower(concat_ws(' ', task_id, task_target, instance, stage, CASE WHEN p_seg IS NOT NULL THEN 'psegment ' || p_seg || ' pperiod ' || p_per || ' pmode full' END)), 'srv1 extract')""")
def search_tasks(spark, sf):
    return h.search_tasks(executions(spark, sf), "SRV1 Extract", ("load",)).select("id", "task_id")


@query("workflow_ci", """WITH wanted AS (SELECT DISTINCT lower('WF_' || (user_id % 7)) AS workflow FROM events)
 SELECT workflow, count(run_id) AS run_count, CASE WHEN count(run_id) = 0 THEN 'No runs found for workflow: ' || workflow END AS error
 FROM wanted LEFT JOIN runs USING (workflow) GROUP BY workflow""")
def workflow_ci(spark, sf):
    from catalog.tables import table
    wanted = table(spark, sf, "events").select(F.concat(F.lit("WF_"), (F.col("user_id") % 7).cast("string")).alias("workflow"))
    return h.select_workflow(runs(spark, sf), wanted)


TOTALS = """count(*) AS total_records, count(DISTINCT run_id) AS run_count, count(DISTINCT task_signature) AS unique_tasks,
 min(start_time) AS first_start, max(start_time) AS last_start, count(*) FILTER (status = 'Success') / count(*) * 100 AS success_rate"""


@query("history_stats", f"SELECT {TOTALS}, count(DISTINCT workflow) AS workflow_count FROM ex", dbl="success_rate:1", ts="first_start,last_start")
def history_stats(spark, sf):
    return h.history_stats(executions(spark, sf))


@query("workflow_stats", f"""SELECT workflow, {TOTALS}, avg(duration_seconds) FILTER (status = 'Success') AS avg_duration,
 min(duration_seconds) FILTER (status = 'Success') AS min_duration, max(duration_seconds) FILTER (status = 'Success') AS max_duration
 FROM ex GROUP BY workflow""", dbl="success_rate:1,avg_duration:2,min_duration:2,max_duration:2", ts="first_start,last_start")
def workflow_stats(spark, sf):
    return h.workflow_stats(executions(spark, sf))


def _states(spark, sf):
    """States of three batches, appended one after the other and read as one."""
    path, t = scratch(spark), executions(spark, sf)
    for k in range(3):
        summaries.append_state(t.where(F.col("id") % 3 == k), path)
    return summaries.read_states(spark, path)


@query("merged_history_stats", f"SELECT {TOTALS}, count(DISTINCT workflow) AS workflow_count FROM ex", dbl="success_rate:1", ts="first_start,last_start")
def merged_history_stats(spark, sf):
    return summaries.history_stats(_states(spark, sf))


@query("merged_workflow_stats", f"""SELECT workflow, {TOTALS}, avg(duration_seconds) FILTER (status = 'Success') AS avg_duration,
 min(duration_seconds) FILTER (status = 'Success') AS min_duration, max(duration_seconds) FILTER (status = 'Success') AS max_duration
 FROM ex GROUP BY workflow""", dbl="success_rate:1,avg_duration:2,min_duration:2,max_duration:2", ts="first_start,last_start")
def merged_workflow_stats(spark, sf):
    return summaries.workflow_stats(_states(spark, sf))


@query("list_workflows", """SELECT workflow, count(*) AS record_count, count(DISTINCT run_id) AS run_count,
 count(DISTINCT task_signature) AS task_count, max(start_time) AS last_run FROM ex GROUP BY workflow ORDER BY last_run DESC""", ts="last_run")
def list_workflows(spark, sf):
    return h.list_workflows(executions(spark, sf))


@query("list_runs", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY start_time DESC, run_id DESC) AS rn FROM runs),
 t AS (SELECT run_id, sum(duration_seconds) AS total, count(*) AS n, count(*) FILTER (status = 'Success') AS good FROM ex GROUP BY run_id),
 j AS (SELECT r.*, t.total, CASE WHEN coalesce(task_count, 0) = 0 THEN coalesce(n, 0) ELSE task_count END AS tc,
   coalesce(success_count, good, 0) AS sc FROM r LEFT JOIN t USING (run_id) WHERE rn <= 20)
 SELECT workflow, run_id, start_time, end_time, duration_seconds, tc AS task_count, sc AS success_count,
   CASE WHEN tc > 0 THEN sc / tc * 100 ELSE 0 END AS success_rate, coalesce(total, 0) AS total_task_duration FROM j""",
       dbl="duration_seconds:2,success_rate:1,total_task_duration:2", ts="start_time,end_time")
def list_runs(spark, sf):
    return h.list_runs(runs(spark, sf), executions(spark, sf))


@query("list_tasks", """SELECT workflow, task_signature, min_by(task_id, id) AS task_id, min_by(instance, id) AS instance,
 arg_min_null(process, id) AS process, count(*) AS run_count, avg(duration_seconds) AS avg_duration,
 count(*) FILTER (status = 'Success') / count(*) * 100 AS success_rate FROM ex GROUP BY workflow, task_signature""", dbl="avg_duration:2,success_rate:1")
def list_tasks(spark, sf):
    return h.list_tasks(executions(spark, sf))


@query("workflow_signatures", "SELECT DISTINCT workflow, task_signature FROM ex")
def workflow_signatures(spark, sf):
    return h.workflow_signatures(executions(spark, sf))


@query("sample_count", "SELECT task_signature, count(*) FILTER (status = 'Success') AS samples FROM ex GROUP BY task_signature")
def sample_count(spark, sf):
    return h.sample_count(executions(spark, sf))


@query("run_task_stats", """SELECT run_id, sum(duration_seconds) AS total_duration, count(*) AS task_count, avg(duration_seconds) AS avg_duration
 FROM ex WHERE status = 'Success' GROUP BY run_id""", dbl="total_duration:6,avg_duration:6")
def run_task_stats(spark, sf):
    return h.run_task_stats(executions(spark, sf))


@query("run_distribution", """WITH l AS (SELECT run_id, list(duration_seconds ORDER BY duration_seconds) AS d FROM ex
   WHERE status = 'Success' AND duration_seconds IS NOT NULL GROUP BY run_id),
 q AS (SELECT run_id, d, len(d) AS n, CASE WHEN len(d) >= 4 THEN d[len(d) // 4 + 1] ELSE d[1] END AS q1,
   CASE WHEN len(d) >= 4 THEN d[(3 * len(d)) // 4 + 1] ELSE d[len(d)] END AS q3 FROM l)
 SELECT run_id, coalesce(d[1], 0) AS min, coalesce(q1, 0) AS q1, coalesce(list_median(d), 0) AS median, coalesce(q3, 0) AS q3,
   coalesce(d[n], 0) AS max, coalesce(list_avg(d), 0) AS mean, coalesce(CASE WHEN n > 1 THEN list_stddev_samp(d) END, 0) AS std_dev,
   coalesce(len(list_filter(d, lambda x: x > q3 + 1.5 * (q3 - q1))), 0) AS outlier_count FROM runs LEFT JOIN q USING (run_id)""",
       dbl="min:2,q1:2,median:2,q3:2,max:2,mean:2,std_dev:2")
def run_distribution(spark, sf):
    return h.run_distribution(runs(spark, sf), executions(spark, sf))


PER_TASK = """task_signature, min_by(task_id, id) AS task_id, min_by(instance, id) AS instance, arg_min_null(process, id) AS process,
 arg_min_null(chore, id) AS chore, min_by(task_target, id) AS task_target, min_by(task_kind, id) AS task_kind, count(*) AS executions,
 count(*) FILTER (status = 'Success') / count(*) * 100 AS success_rate"""


@query("task_summaries", f"""SELECT {PER_TASK}, coalesce(avg(duration_seconds), 0) AS avg_duration, coalesce(min(duration_seconds), 0) AS min_duration,
 coalesce(max(duration_seconds), 0) AS max_duration, coalesce(stddev_samp(duration_seconds), 0) AS std_dev FROM ex GROUP BY task_signature""",
       dbl="success_rate:1,avg_duration:2,min_duration:2,max_duration:2,std_dev:2")
def task_summaries(spark, sf):
    return h.task_summaries(executions(spark, sf))


TASK_TABLE = f"""SELECT *, CASE WHEN avg > 0 THEN std / avg ELSE 0 END AS cv, coalesce(CASE WHEN avg > 0 THEN std / avg ELSE 0 END > 0.5, false) AS high_cv
 FROM (SELECT {PER_TASK}, coalesce(avg(duration_seconds), 0) AS avg, coalesce(min(duration_seconds), 0) AS min,
 coalesce(max(duration_seconds), 0) AS max, coalesce(stddev_samp(duration_seconds), 0) AS std
 FROM ex WHERE run_id IN (SELECT run_id FROM recent5) GROUP BY task_signature)"""


@query("task_table", TASK_TABLE, dbl="success_rate:1,avg,min,max,std,cv")
def task_table(spark, sf):
    return h.task_table(executions(spark, sf), runs(spark, sf), 5)


@query("workflow_meta", """SELECT workflow, max_by(taskfile_name, start_time) AS taskfile_name, max_by(taskfile_description, start_time) AS taskfile_description,
 max_by(taskfile_author, start_time) AS taskfile_author, count(*) AS run_count, least(5, count(*)) AS default_runs FROM runs GROUP BY workflow""")
def workflow_meta(spark, sf):
    return h.workflow_meta(runs(spark, sf))


@query("summary_cards", """SELECT workflow, count(*) AS runs_shown, sum(coalesce(task_count, 0)) AS total_tasks, sum(coalesce(success_count, 0)) AS total_success,
 max(coalesce(task_count, 0)) FILTER (rn = 1) AS tasks_per_run, sum(coalesce(success_count, 0)) / sum(coalesce(task_count, 0)) * 100 AS success_rate,
 min(nullif(duration_seconds, 0)) AS best_duration, avg(nullif(duration_seconds, 0)) AS avg_duration,
 count(DISTINCT nullif(max_workers, 0)) AS worker_levels FROM recent5 GROUP BY workflow""", dbl="success_rate:1,best_duration,avg_duration")
def summary_cards(spark, sf):
    return h.summary_cards(runs(spark, sf), 5)


@query("stage_totals", "SELECT run_id, stage, sum(duration_seconds) AS total_duration FROM ex WHERE stage <> '' GROUP BY run_id, stage", dbl="total_duration:2")
def stage_totals(spark, sf):
    return h.stage_totals(executions(spark, sf))


@query("stage_averages", """SELECT stage, avg(duration_seconds) FILTER (status = 'Success') AS avg_duration, count(duration_seconds) FILTER (status = 'Success') AS n,
 list_position(['extract', 'input', 'transform', 'analysis', 'load', 'export', 'reporting'], stage) AS place FROM ex WHERE stage <> '' GROUP BY stage""", dbl="avg_duration:2")
def stage_averages(spark, sf):
    return h.stage_averages(executions(spark, sf))


@query("run_status_counts", """SELECT run_id, coalesce(success_count, 0) AS success_count, coalesce(failure_count, 0) AS failure_count,
 coalesce(n, 0) AS task_count_actual, coalesce(bad, 0) AS failure_count_actual FROM runs LEFT JOIN
 (SELECT run_id, count(*) AS n, count(*) FILTER (status <> 'Success') AS bad FROM ex GROUP BY run_id) USING (run_id)""")
def run_status_counts(spark, sf):
    return h.run_status_counts(runs(spark, sf), executions(spark, sf))


SUMMARY_SQL = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY start_time, id) AS k FROM res),
 t AS (SELECT run_id, task_id, count(*) AS cnt, count(*) FILTER (status = 'Success') AS good, min(start_time) AS s, max(end_time) AS e,
   sum(retry_count)::BIGINT AS tries, arg_min(error_message, k) AS error FROM o GROUP BY run_id, task_id)
SELECT run_id, task_id, id, workflow, instance, process, array_to_string(preds, '|') AS predecessors, stage,
 CASE WHEN cnt = 1 THEN status WHEN good = cnt THEN 'Success' WHEN good = 0 THEN 'Fail' ELSE 'Partial (' || good || '/' || cnt || ' Success)' END AS status,
 s AS start_time, e AS end_time, CASE WHEN cnt > 1 THEN (epoch_us(e) - epoch_us(s)) / 1000000.0 ELSE duration_seconds END AS duration_seconds,
 CASE WHEN cnt > 1 THEN '{"expanded": ' || cnt || '}' ELSE params END AS parameters, coalesce(error, '') AS error_message, tries AS retry_count, cnt AS instances
FROM o JOIN t USING (run_id, task_id) WHERE k = 1"""


@query("expanded_details", """SELECT run_id, task_id, row_number() OVER (PARTITION BY run_id, task_id ORDER BY start_time, id) AS instance_no,
 params AS parameters, coalesce(error_message, '') AS error_message FROM res""")
def expanded_details(spark, sf):
    return h.expanded_details(results(spark, sf))


@query("expanded_summary", SUMMARY_SQL, dbl="duration_seconds:3", ts="start_time,end_time")
def expanded_summary(spark, sf):
    return h.expanded_summary(results(spark, sf)).withColumn("predecessors", F.array_join("predecessors", "|")).select(
        "run_id", "task_id", "id", "workflow", "instance", "process", "predecessors", "stage", "status", "start_time", "end_time",
        "duration_seconds", "parameters", "error_message", "retry_count", "instances")


@query("result_and", """SELECT run_id, task_id, count(*) AS instances, bool_and(status = 'Success' OR retry_count < 2) AS complete,
 bool_and(status = 'Success') FILTER (status = 'Success' OR retry_count < 2) AS success FROM res GROUP BY run_id, task_id""")
def result_and(spark, sf):
    good = F.col("status") == "Success"
    state = F.when(good, "completed").when(F.col("retry_count") < 2, "failed").otherwise("running")
    return h.result_and(results(spark, sf).withColumn("state", state).withColumn("success", good))


@query("remaining_by_instance", """SELECT run_id, instance, count(*) AS remaining FROM ex WHERE status <> 'Success' AND retry_count > 0 GROUP BY run_id, instance""")
def remaining_by_instance(spark, sf):
    state = F.when(F.col("status") == "Success", "completed").when(F.col("retry_count") == 0, "failed") \
        .when(F.col("retry_count") == 1, "pending").otherwise("running")
    return h.remaining_by_instance(executions(spark, sf).withColumn("state", state))


@query("run_clock", """SELECT run_id, min(start_time) AS start_time, max(end_time) AS end_time,
 (epoch_us(max(end_time)) - epoch_us(min(start_time))) / 1000000.0 AS wall_seconds, coalesce(sum(duration_seconds), 0) AS task_seconds,
 count(*) FILTER (status = 'Success') AS success_count, count(*) FILTER (status <> 'Success') AS failure_count FROM ex GROUP BY run_id""",
       dbl="wall_seconds,task_seconds", ts="start_time,end_time")
def run_clock(spark, sf):
    return h.run_clock(executions(spark, sf))


@query("workflow_drift", """SELECT workflow, count(*) AS runs, avg(duration_seconds) AS avg_duration, max(duration_seconds) - min(duration_seconds) AS spread
 FROM runs WHERE start_time >= TIMESTAMP '2024-01-11' GROUP BY workflow""", dbl="avg_duration,spread")
def workflow_drift(spark, sf):
    return h.workflow_drift(runs(spark, sf), NOW, 20)


CKPT_STATE = """CASE WHEN status = 'Success' THEN 'completed' WHEN retry_count = 0 THEN 'failed' WHEN retry_count = 1 THEN 'pending'
 WHEN id % 2 = 0 THEN 'in_progress' ELSE 'skipped' END"""


def state_of(tasks):
    s = F.when(F.col("status") == "Success", "completed").when(F.col("retry_count") == 0, "failed") \
        .when(F.col("retry_count") == 1, "pending").when(F.col("id") % 2 == 0, "in_progress").otherwise("skipped")
    return tasks.withColumn("checkpoint", F.col("run_id")).withColumn("state", s)


@query("checkpoint_progress", f"""SELECT run_id AS checkpoint, count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'in_progress') AS in_progress,
 count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped,
 count(*) FILTER (s = 'completed' AND id % 3 > 0) AS success_count, count(*) FILTER (s = 'completed') / 400.0 * 100 AS progress_percentage,
 count(*) FILTER (s IN ('pending', 'in_progress')) = 0 AS is_complete
 FROM (SELECT run_id, id, {CKPT_STATE} AS s FROM ex) GROUP BY run_id""", dbl="progress_percentage:1")
def checkpoint_progress(spark, sf):
    t = state_of(executions(spark, sf)).withColumn("total_tasks", F.lit(400)).withColumn("success", F.col("id") % 3 > 0)
    return h.checkpoint_progress(t)


@query("union_backends", f"""SELECT run_id, task_id, id, status, CAST(NULL AS VARCHAR) AS stage FROM ex WHERE id % 2 = 0
 UNION ALL SELECT run_id, task_id, id, status, stage FROM ex WHERE id % 2 = 1""")
def union_backends(spark, sf):
    t = executions(spark, sf)
    table_rows = t.filter("id % 2 = 1")
    items = readers.normalise_items(t.filter("id % 2 = 0").withColumn("task_result_id", _item_key()).drop("stage", "id").withColumn("parameters", F.to_json("parameters")))
    return readers.union_sources([table_rows, items]).select(
        "run_id", "task_id", F.coalesce("id", _id_of_key()).alias("id"), "status", "stage")


assert set(EX_LIST) < set(TASKS.fieldNames())
