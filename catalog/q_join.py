"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.q_history import CKPT_STATE, state_of
from catalog.registry import query, scratch
from catalog.tables import definitions, executions, results, runs, sessions, table
from runtally.operators import joins as j
from runtally.operators.windows import default_estimate
from runtally.plans.estimates import per_workflow, estimates_with_defaults, signature_history
from runtally.sources import readers, writers


@query("overlap_count", "SELECT run_id, id, task_id, concurrent_count, duration_seconds FROM overl", dbl="duration_seconds:3")
def overlap_count(spark, sf):
    return j.overlap_count(executions(spark, sf)).select("run_id", "id", "task_id", "concurrent_count", "duration_seconds")


@query("runs_with_tasks", """SELECT r.run_id, lower(r.workflow) AS workflow, r.start_time AS run_start, max_workers, r.status AS run_status, e.id, e.task_id, e.status
 FROM runs r LEFT JOIN ex e USING (run_id)""", ts="run_start")
def runs_with_tasks(spark, sf):
    return j.runs_with_tasks(runs(spark, sf), executions(spark, sf)).select(
        "run_id", "workflow", "run_start", "max_workers", "run_status", "id", "task_id", "status")


@query("run_details", """WITH h AS (SELECT *, true AS has FROM runs WHERE CAST(substr(run_id, 7, 2) AS INTEGER) % 8 <> 0),
 t AS (SELECT run_id, min(workflow) AS wf, min(start_time) AS s, max(end_time) AS e, count(*) AS n, count(*) FILTER (status = 'Success') AS good,
   count(*) FILTER (status <> 'Success') AS bad, sum(duration_seconds) AS total FROM ex GROUP BY run_id)
 SELECT run_id, CASE WHEN has THEN workflow ELSE wf END AS workflow, CASE WHEN has THEN start_time ELSE s END AS start_time,
 CASE WHEN has THEN end_time ELSE e END AS end_time, nullif(duration_seconds, 0) AS duration_seconds,
 CASE WHEN has THEN coalesce(task_count, 0) ELSE n END AS task_count, CASE WHEN has THEN coalesce(success_count, 0) ELSE good END AS success_count,
 CASE WHEN has THEN coalesce(failure_count, 0) ELSE bad END AS error_count,
 CASE WHEN has THEN coalesce(success_count / nullif(task_count, 0) * 100, 0) ELSE good / n * 100 END AS success_rate,
 coalesce(total, 0) AS total_task_duration, coalesce(has, false) AS has_header FROM h FULL JOIN t USING (run_id)""",
       dbl="duration_seconds:2,success_rate:1,total_task_duration:2", ts="start_time,end_time")
def run_details(spark, sf):
    some = runs(spark, sf).filter(F.substring("run_id", 7, 2).cast("int") % 8 != 0)
    return j.run_details(some, executions(spark, sf))


@query("complete_run", """SELECT run_id, max(end_time) AS end_time, CAST(epoch_us(max(end_time)) - epoch_us(min(start_time)) AS DOUBLE) / 1000000 AS duration_seconds,
 CASE WHEN CAST(substr(run_id, 7, 2) AS INTEGER) % 4 <> 0 THEN 'Success' WHEN count(*) FILTER (status = 'Success') > 0 THEN 'Partial' ELSE 'Failed' END AS status,
 count(*) AS task_count, count(*) FILTER (status = 'Success') AS success_count, count(*) FILTER (status <> 'Success') AS failure_count FROM ex GROUP BY run_id""",
       dbl="duration_seconds:3", ts="end_time")
def complete_run(spark, sf):
    r = runs(spark, sf)
    opened = writers.start_run(r)
    raised = r.filter(F.substring("run_id", 7, 2).cast("int") % 4 == 0).select("run_id")
    return j.complete_run(opened, executions(spark, sf), raised).select(
        "run_id", "end_time", "duration_seconds", "status", "task_count", "success_count", "failure_count")


@query("estimate_join", """SELECT id, e.workflow, e.task_signature, CASE WHEN coalesce(sample_count, 0) >= 3 THEN ewma ELSE default_estimate END AS estimate
 FROM ex e LEFT JOIN sighist USING (task_signature) JOIN wfdefault d ON d.workflow = e.workflow""", dbl="estimate")
def estimate_join(spark, sf):
    t = executions(spark, sf)
    hist = signature_history(t)
    return j.estimate_join(t.select("id", "workflow", "task_signature"), hist, default_estimate(per_workflow(t, hist)))


@query("latest_snapshot", "SELECT workflow, run_id, taskfile_path FROM newest")
def latest_snapshot(spark, sf):
    return j.latest_snapshot(runs(spark, sf))


@query("checkpoint_match", """SELECT 'ckpt_' || run_id AS checkpoint, taskfile_path, day AS d, day % 3 = 0 AS changed, day % 3 <> 0 AS valid,
 CASE WHEN day % 3 = 0 THEN 'ERROR: task file changed since checkpoint, was ' || substr(sha256('v1' || run_id), 1, 8) || ' now ' || substr(sha256('v2' || run_id), 1, 8) END AS message
 FROM (SELECT *, CAST(substr(run_id, 7, 2) AS INTEGER) AS day FROM runs)""".replace(" day AS d,", ""))
def checkpoint_match(spark, sf):
    r = runs(spark, sf)
    day = F.substring("run_id", 7, 2).cast("int")
    version = lambda v: F.sha2(F.concat(F.lit(v), "run_id"), 256)
    saved = r.select(F.concat(F.lit("ckpt_"), "run_id").alias("checkpoint"), "taskfile_path", version("v1").alias("taskfile_hash"))
    now = r.select("taskfile_path", F.when(day % 3 == 0, version("v2")).otherwise(version("v1")).alias("current_hash"))
    return j.checkpoint_match(saved, now)


@query("checkpoint_files_match", """WITH f AS (SELECT run_id, string_agg(task_id || ' ' || id || chr(10), '' ORDER BY id) AS v1, CAST(substr(run_id, 7, 2) AS INTEGER) % 3 = 0 AS edited FROM ex GROUP BY run_id)
 SELECT 'ckpt_' || run_id AS checkpoint, run_id AS taskfile_path, edited AS changed, NOT edited AS valid, CASE WHEN edited THEN 'ERROR: task file changed since checkpoint, was '
   || substr(sha256(v1), 1, 8) || ' now ' || substr(sha256(v1 || 'edited' || chr(10)), 1, 8) END AS message FROM f""")
def checkpoint_files_match(spark, sf):
    """Task files are written, hashed for their checkpoints, every third day's written again with a line more, and hashed again."""
    t = executions(spark, sf)
    line = t.select("run_id", "id", F.concat_ws(" ", "task_id", F.col("id").cast("string")).alias("value"))
    edited = F.substring("run_id", 7, 2).cast("int") % 3 == 0
    more = line.where(edited).select("run_id").distinct().select("run_id", F.lit(1 << 60).alias("id"), F.lit("edited").alias("value"))

    def hashed(lines):
        path = scratch(spark)
        lines.repartition("run_id").sortWithinPartitions("run_id", "id").select("run_id", "value").write.partitionBy("run_id").text(path)
        return readers.file_hashes(spark, path).withColumn("taskfile_path", F.regexp_extract("taskfile_path", "run_id=([^/]+)/", 1))

    then = hashed(line).select(F.concat(F.lit("ckpt_"), "taskfile_path").alias("checkpoint"), "taskfile_path", F.col("current_hash").alias("taskfile_hash"))
    return j.checkpoint_match(then, hashed(line.unionByName(more)))


@query("blocking_sessions", """SELECT a.session, a.instance, a.start_time, a.end_time, a.exclusive, count(b.session) AS blocking, count(b.session) > 0 AS must_wait
 FROM sess a LEFT JOIN sess b ON a.instance = b.instance AND a.session <> b.session AND b.start_time < a.end_time AND b.end_time > a.start_time
 AND (a.exclusive OR b.exclusive) GROUP BY ALL""", ts="start_time,end_time")
def blocking_sessions(spark, sf):
    return j.blocking_sessions(sessions(spark, sf))


@query("fan_out_predecessors", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY id) AS k, count(*) OVER (PARTITION BY run_id, task_id) AS m FROM res),
 w AS (SELECT run_id, CASE WHEN m > 1 THEN task_id || '.' || k ELSE task_id END AS node_id, unnest([0, 1]) AS pred_no, unnest(preds) AS predecessor FROM o WHERE preds IS NOT NULL),
 s AS (SELECT run_id, task_id AS predecessor, count(*) AS m FROM res GROUP BY run_id, task_id)
 SELECT run_id, node_id, pred_no, predecessor, m AS predecessor_instances, CASE WHEN m > 1 THEN predecessor || '.1' ELSE predecessor END AS first_node,
 CASE WHEN m > 1 THEN predecessor || '.' || m ELSE predecessor END AS last_node FROM w JOIN s USING (run_id, predecessor)""")
def fan_out_predecessors(spark, sf):
    return j.fan_out_predecessors(results(spark, sf))


@query("dangling_predecessors", """SELECT DISTINCT workflow, d.id AS task_id, p AS predecessor FROM (SELECT workflow, id, unnest(preds) AS p FROM defs) d
 WHERE NOT EXISTS (SELECT 1 FROM defs x WHERE x.workflow = d.workflow AND x.id = d.p)""")
def dangling_predecessors(spark, sf):
    return j.dangling_predecessors(definitions(spark, sf), ["workflow"])


@query("stage_edges", """WITH s AS (SELECT DISTINCT workflow, id, list_position(['extract', 'transform', 'load'], stage) - 1 AS k FROM defs)
 SELECT workflow, id AS pred, 'gate:' || (k + 1) AS succ FROM s WHERE (workflow, k + 1) IN (SELECT (workflow, k) FROM s)
 UNION ALL SELECT workflow, 'gate:' || k, id FROM s WHERE (workflow, k - 1) IN (SELECT (workflow, k) FROM s)""")
def stage_edges(spark, sf):
    return j.stage_edges(definitions(spark, sf), ["workflow"], ("extract", "transform", "load"))


def _elements(spark, sf):
    region = table(spark, sf, "region").select(F.lit("regions").alias("set_name"), (F.col("r_regionkey") + 1).alias("element_no"), F.col("r_name").alias("element"))
    nation = table(spark, sf, "nation").select(F.lit("nations").alias("set_name"), (F.col("n_nationkey") + 1).alias("element_no"), F.col("n_name").alias("element"))
    return region.unionByName(nation)


def _wild(spark, sf):
    one = F.create_map(F.lit("pKeep"), F.lit("1"), F.lit("pRegion*"), F.lit("*regions"))
    two = F.create_map(F.lit("pRegion*"), F.lit("*regions"), F.lit("pNation*"), F.lit("*nations"))
    k = F.col("pos")
    return definitions(spark, sf).withColumn("parameters", F.when(k % 50 == 0, two).when(k % 10 == 0, one).otherwise(F.col("parameters")))


EXPANDED = """
expanded AS (SELECT workflow, id, CASE WHEN pos % 50 = 0 THEN id || '_' || (r_regionkey * 25 + n_nationkey + 1) ELSE id || '_' || (r_regionkey + 1) END AS expanded_id,
   CASE WHEN pos % 50 = 0 THEN '{"pRegion": "' || r_name || '", "pNation": "' || n_name || '"}' ELSE '{"pKeep": "1", "pRegion": "' || r_name || '"}' END AS params
   FROM defs CROSS JOIN region CROSS JOIN nation WHERE pos % 10 = 0 AND (pos % 50 = 0 OR n_nationkey = 0)
 UNION ALL SELECT workflow, id, id, CASE WHEN p_seg IS NULL THEN '{}' ELSE '{"pSegment": "' || p_seg || '", "pPeriod": "' || p_per || '"}' END FROM defs WHERE pos % 10 <> 0)"""


@query("expand_wildcards", f"WITH {EXPANDED} SELECT * FROM expanded")
def expand_wildcards(spark, sf):
    from runtally.functions.scalars import json_map
    return j.expand_wildcards(_wild(spark, sf), _elements(spark, sf), ["workflow"]).select(
        "workflow", "id", "expanded_id", json_map("parameters").alias("params"))


@query("remap_predecessors", f"""WITH {EXPANDED}, w AS (SELECT workflow, id, unnest(preds) AS p, unnest(range(len(preds)))::INTEGER AS pred_no FROM defs)
 SELECT w.workflow, w.id, pred_no, coalesce(e.expanded_id, p) AS predecessor FROM w LEFT JOIN expanded e ON e.workflow = w.workflow AND e.id = w.p""")
def remap_predecessors(spark, sf):
    d = _wild(spark, sf)
    return j.remap_predecessors(d, j.expand_wildcards(d, _elements(spark, sf), ["workflow"]), ["workflow"])


@query("apply_order", """WITH o AS (SELECT workflow, CASE WHEN pos % 9 = 0 THEN 'gone' || id ELSE id END AS id, min(cust * 1000000 + pos) AS rank FROM defs WHERE pos % 3 <> 1 GROUP BY ALL)
 SELECT d.workflow, d.id, row_number() OVER (PARTITION BY d.workflow ORDER BY rank NULLS LAST, pos) AS new_pos FROM defs d LEFT JOIN o ON o.workflow = d.workflow AND o.id = d.id
 UNION ALL SELECT workflow, id, NULL FROM o WHERE id LIKE 'gone%'""")
def apply_order(spark, sf):
    d = definitions(spark, sf)
    cust = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("cust"))
    order = d.join(cust, "pos").filter("pos % 3 <> 1").select(
        "workflow", F.when(F.col("pos") % 9 == 0, F.concat(F.lit("gone"), "id")).otherwise(F.col("id")).alias("id"),
        (F.col("cust") * 1000000 + F.col("pos")).alias("rank"))
    new, dropped = j.apply_order(d, order, ["workflow"])
    return new.select("workflow", "id", "new_pos").unionByName(dropped.withColumn("new_pos", F.lit(None).cast("long")))


@query("upsert_members", """SELECT task_signature AS member, min(start_time) >= TIMESTAMP '2024-01-03' AS added FROM ex GROUP BY task_signature""")
def upsert_members(spark, sf):
    t = executions(spark, sf).select(F.col("task_signature").alias("member"), "start_time")
    old = t.filter("start_time < timestamp'2024-01-03'").select("member").distinct()
    return j.upsert_members(old, t)


MODE_SETS = """SELECT 'opt' AS kind, unnest(['instance', 'process', 'chore', 'parameters', 'retries', 'predecessors', 'stage', 'safe_retry', 'timeout',
 'cancel_at_timeout', 'require_predecessor_success', 'succeed_on_minor_errors']) AS measure
 UNION ALL SELECT 'norm', unnest(['instance', 'process', 'chore', 'parameters', 'retries', 'predecessors', 'stage', 'safe_retry', 'timeout', 'cancel_at_timeout'])
 UNION ALL SELECT 'results', unnest(['instance', 'process', 'chore', 'parameters', 'status', 'start_time', 'end_time', 'duration_seconds', 'retry_count', 'error_message',
 'predecessors', 'stage', 'safe_retry', 'timeout', 'cancel_at_timeout', 'require_predecessor_success', 'succeed_on_minor_errors', 'original_task_id'])"""


@query("input_measures", f"SELECT kind, measure FROM ({MODE_SETS}) WHERE (SELECT count(*) FROM ex) > 0")
def input_measures(spark, sf):
    t = executions(spark, sf)
    cells = writers.results_to_cells(writers.results_table(t, keep=("id",)))
    parts = [j.input_measures(cells, m).select(F.lit(m).alias("kind"), "measure") for m in ("opt", "norm")]
    return parts[0].unionByName(parts[1]).unionByName(j.result_measures(cells).select(F.lit("results").alias("kind"), "measure"))


@query("resume_set", f"""SELECT checkpoint, task_id, max(action) AS action FROM (SELECT run_id AS checkpoint, task_id,
 CASE WHEN s = 'pending' THEN 'run' WHEN s = 'in_progress' THEN CASE WHEN safe_retry THEN 'run' ELSE 'decide' END END AS action
 FROM (SELECT *, {CKPT_STATE} AS s FROM ex)) WHERE action IS NOT NULL GROUP BY checkpoint, task_id""")
def resume_set(spark, sf):
    return j.resume_set(state_of(executions(spark, sf)))


@query("resume_from", f"""WITH s AS (SELECT run_id AS checkpoint, task_id, id, {CKPT_STATE} AS s FROM ex),
 d AS (SELECT checkpoint, task_id, min(id) AS pos, bool_or(s = 'completed') AS done, bool_or(s = 'pending') AS wait FROM s GROUP BY checkpoint, task_id),
 st AS (SELECT run_id AS checkpoint, CAST(CAST(substr(run_id, 7, 2) AS INTEGER) * 5 + CAST(substr(run_id, 10) AS INTEGER) AS VARCHAR) AS resume_from FROM runs),
 a AS (SELECT st.*, d.pos AS at_pos FROM st LEFT JOIN d ON d.checkpoint = st.checkpoint AND d.task_id = st.resume_from)
 SELECT d.checkpoint, d.task_id, CASE WHEN done THEN 'completed' WHEN pos >= at_pos OR wait THEN 'run' ELSE 'skipped' END AS action FROM d JOIN a USING (checkpoint) WHERE at_pos IS NOT NULL
 UNION ALL SELECT checkpoint, resume_from, 'error' FROM a WHERE at_pos IS NULL""")
def resume_from(spark, sf):
    state = state_of(executions(spark, sf))
    defs = state.groupBy("checkpoint", "task_id").agg(F.min("id").alias("pos"))
    start = runs(spark, sf).select(F.col("run_id").alias("checkpoint"), (
        F.substring("run_id", 7, 2).cast("int") * 5 + F.substring("run_id", 10, 9).cast("int")).cast("string").alias("resume_from"))
    return j.resume_from(defs, state, start)


@query("with_defaults", """SELECT workflow, task_signature, ewma, estimated FROM analysis""", dbl="ewma")
def with_defaults(spark, sf):
    return estimates_with_defaults(executions(spark, sf))


@query("instances", "SELECT DISTINCT workflow, instance FROM defs")
def instances(spark, sf):
    return j.instances(definitions(spark, sf))
