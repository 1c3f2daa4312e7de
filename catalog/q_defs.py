"""Task definitions, cells, checkpoints, sinks and structural checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.q_history import CKPT_STATE, state_of
from catalog.registry import query, scratch
from catalog.tables import dag_defs, definitions, executions, faulty_definitions, results, runs, table
from runtally.functions.scalars import json_map, task_line
from runtally.operators import checks
from runtally.schemas import CHECKPOINT_DOC, TASKFILE_DOC, UPLOAD_COLUMNS
from runtally.sources import readers, writers

DEF_JSON = """'{"id": "' || id || '", "instance": "' || instance || '"' || CASE WHEN process IS NOT NULL THEN ', "process": "' || process || '"' ELSE '' END
 || CASE WHEN chore IS NOT NULL THEN ', "chore": "' || chore || '"' ELSE '' END
 || CASE WHEN p_seg IS NOT NULL THEN ', "parameters": {"pSegment": "' || p_seg || '", "pPeriod": "' || p_per || '"}' ELSE '' END
 || CASE WHEN len(preds) > 0 THEN ', "predecessors": [' || array_to_string(list_transform(preds, lambda p: '"' || p || '"'), ', ') || ']' ELSE '' END
 || ', "stage": "' || stage || '"' || CASE WHEN safe_retry THEN ', "safe_retry": true' ELSE '' END
 || CASE WHEN timeout IS NOT NULL THEN ', "timeout": ' || timeout ELSE '' END || CASE WHEN cancel_at_timeout THEN ', "cancel_at_timeout": true' ELSE '' END
 || CASE WHEN require_predecessor_success THEN ', "require_predecessor_success": true' ELSE '' END
 || CASE WHEN succeed_on_minor_errors THEN ', "succeed_on_minor_errors": true' ELSE '' END || '}'"""


# ---- sources ----------------------------------------------------------------

def _docs(spark, sf):
    """One small JSON document per order: a graph as a task file."""
    d = dag_defs(spark, sf)
    task = F.struct(F.col("id").cast("int").alias("id"), F.concat(F.lit("srv"), "id").alias("instance"),
                    F.when(F.col("bad") == 0, F.concat(F.lit("p"), "id")).alias("process"),
                    F.when(F.col("bad") > 0, F.lit("c1")).alias("chore"), "predecessors",
                    F.when(F.col("require_predecessor_success"), F.lit(True)).alias("require_predecessor_success"))
    wf = F.concat(F.lit("wf_"), (F.col("run_id") % 5).cast("string"))
    return d.groupBy("run_id").agg(F.array_sort(F.collect_list(task)).alias("tasks")).select(
        F.concat(F.lit("archive/"), wf, F.lit("/"), F.col("run_id").cast("string"), F.lit(".json")).alias("file"),
        F.to_json(F.struct(F.when(F.col("run_id") % 11 != 0, F.lit("2.0")).alias("version"),
                           F.struct((F.col("run_id") % 4).alias("max_workers"), F.array(F.lit("a"), F.lit("b")).alias("stage_order")).alias("settings"),
                           "tasks")).alias("text"))


def _parsed(spark, sf):
    return readers.taskfile_tables(_docs(spark, sf).select("file", F.from_json("text", TASKFILE_DOC).alias("d")).select("file", "d.*"))


@query("read_taskfiles", """SELECT 'wf_' || (run_id % 5) AS workflow, CAST(run_id AS VARCHAR) AS run_id, (row_number() OVER (PARTITION BY run_id ORDER BY CAST(id AS INTEGER)) - 1) AS pos,
 id, 'srv' || id AS instance, CASE WHEN bad = 0 THEN 'p' || id END AS process, CASE WHEN bad > 0 THEN 'c1' END AS chore, array_to_string(preds, ',') AS predecessors,
 require_predecessor_success, false AS safe_retry, CAST(run_id % 4 AS INTEGER) AS max_workers, 'a,b' AS stage_order FROM dag""")
def read_taskfiles(spark, sf):
    files, defs = _parsed(spark, sf)
    return defs.join(files.select("file", "max_workers", F.array_join("stage_order", ",").alias("stage_order")), "file").select(
        "workflow", "run_id", "pos", "id", "instance", "process", "chore", F.array_join("predecessors", ",").alias("predecessors"),
        "require_predecessor_success", "safe_retry", "max_workers", "stage_order")


def _lines(spark, sf):
    """Definitions rendered as task lines, one file per workflow, with comments, blanks and waits."""
    d = definitions(spark, sf)
    k = F.col("pos")
    text = F.when(k % 97 == 0, F.lit("# note")).when(k % 53 == 0, F.lit("  WAIT ")).when(k % 59 == 0, F.lit("   ")) \
        .when(k % 61 == 0, F.lit('id="1" instance="broken')).when(k % 43 == 0, task_line(False)).otherwise(task_line(True))
    return d.select(F.concat("workflow", F.lit(".txt")).alias("file"), (k + 1).alias("line_no"), text.alias("value"))


TASK_LINES = """WITH l AS (SELECT *, pos + 1 AS line_no, pos % 53 = 0 AS is_wait, pos % 43 = 0 AS noid FROM defs
   WHERE pos % 97 <> 0 AND (pos % 53 = 0 OR (pos % 59 <> 0 AND pos % 61 <> 0))),
 n AS (SELECT *, sum(is_wait::INTEGER) OVER w AS sequence, sum((noid AND NOT is_wait)::INTEGER) OVER w AS auto FROM l WINDOW w AS (PARTITION BY workflow ORDER BY pos)),
 s AS (SELECT workflow, sequence, count(*) AS size FROM n WHERE NOT is_wait GROUP BY workflow, sequence)
 SELECT n.workflow, line_no AS pos, CASE WHEN noid THEN CAST(auto AS VARCHAR) ELSE id END AS id, instance, process, chore,
 CASE WHEN p_seg IS NULL THEN '{}' ELSE '{"pPeriod": "' || p_per || '", "pSegment": "' || p_seg || '"}' END AS params,
 CASE WHEN noid THEN '' ELSE array_to_string(preds, ',') END AS predecessors, n.sequence::BIGINT AS sequence, p.sequence::BIGINT AS previous, p.size AS previous_size, stage,
 safe_retry, CASE WHEN chore IS NULL THEN timeout END AS timeout, cancel_at_timeout AND chore IS NULL AS cancel_at_timeout,
 require_predecessor_success AND NOT noid AS require_predecessor_success, succeed_on_minor_errors AND chore IS NULL AS succeed_on_minor_errors
 FROM n LEFT JOIN s p ON p.workflow = n.workflow AND p.sequence = n.sequence - 1 WHERE NOT is_wait"""


@query("read_task_lines", TASK_LINES)
def read_task_lines(spark, sf):
    path = scratch(spark)
    _lines(spark, sf).write.parquet(path)
    return _task_columns(readers.parse_task_lines(spark.read.parquet(path)))


def _task_columns(tasks):
    return tasks.select(
        "workflow", "pos", "id", "instance", "process", "chore", json_map("parameters", sort_keys=True).alias("params"),
        F.array_join("predecessors", ",").alias("predecessors"), "sequence", "previous", "previous_size", "stage", "safe_retry", "timeout",
        "cancel_at_timeout", "require_predecessor_success", "succeed_on_minor_errors")


def _text_files(spark, lines):
    """``lines(file, line_no, value)`` as text files, one a folder ``file=…``, read back as lines with those names."""
    path = scratch(spark)
    lines.repartition("file").sortWithinPartitions("file", "line_no").select("file", "value").write.partitionBy("file").text(path)
    return readers.read_lines(spark, path).withColumn("file", F.regexp_extract("file", "file=([^/]+)/", 1))


# Lines that a workflow lacks between its own positions are not in its file, so numbers in a file run without gaps.
@query("read_task_text", TASK_LINES.replace("SELECT n.workflow, line_no AS pos,", "SELECT n.workflow, text_no AS pos,").replace(
    "FROM defs\n", "FROM (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY pos) AS text_no FROM defs)\n"))
def read_task_text(spark, sf):
    """Task lines written as text files and read from them."""
    return _task_columns(readers.parse_task_lines(_text_files(spark, _lines(spark, sf))))


@query("detect_text_mode", """WITH l AS (SELECT coalesce(lang, 'none') || '-' || (doc_id % 16) || CASE WHEN doc_id % 16 > 11 THEN '.json' ELSE '.txt' END AS file, doc_id, generate_subscripts(s, 1) AS k, unnest(s) AS line
   FROM (SELECT *, string_split(replace(coalesce(text, ''), chr(13), ' '), chr(10)) AS s FROM documents)),
 m AS (SELECT file, doc_id, k, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS v FROM l),
 f AS (SELECT file, arg_min(v, (doc_id, k)) FILTER (v <> '' AND v NOT LIKE '#%') AS v FROM m GROUP BY file),
 t AS (SELECT *, CASE WHEN file LIKE '%.json' OR (file NOT LIKE '%.txt' AND v LIKE '{%') THEN 'json' ELSE 'txt' END AS file_type FROM f),
 d AS (SELECT *, CASE WHEN lower(v) = 'wait' OR starts_with(v, 'instance=') THEN 'norm' WHEN starts_with(v, 'id=') THEN 'opt' END AS mode FROM t)
 SELECT file, file_type, CASE WHEN file_type = 'txt' THEN mode END AS mode,
   CASE WHEN file_type = 'txt' THEN CASE WHEN v IS NULL THEN 'file contains no task definitions' WHEN mode IS NULL THEN 'Cannot determine execution mode: ' || substr(v, 1, 50) END END AS error FROM d""")
def detect_text_mode(spark, sf):
    """The texts of all documents as text files: what stands in them decides."""
    i = F.col("doc_id")
    file = F.concat(F.coalesce("lang", F.lit("none")), F.lit("-"), (i % 16).cast("string"), F.when(i % 16 > 11, ".json").otherwise(".txt"))
    line = table(spark, sf, "documents").select(file.alias("file"), "doc_id", F.posexplode(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit(" ")), "\n", -1)).alias("k", "value"))
    return readers.detect_line_mode(_text_files(spark, line.withColumn("line_no", F.struct("doc_id", "k"))))


@query("detect_line_mode", """SELECT 'd' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.json' ELSE '' END AS file,
 CASE WHEN doc_id % 3 = 1 THEN 'json' ELSE 'txt' END AS file_type,
 CASE WHEN doc_id % 3 <> 1 THEN CASE doc_id % 5 WHEN 0 THEN 'norm' WHEN 1 THEN 'opt' WHEN 2 THEN 'norm' END END AS mode,
 CASE WHEN doc_id % 3 <> 1 THEN CASE doc_id % 5 WHEN 3 THEN 'Cannot determine execution mode: process=' || doc_id WHEN 4 THEN 'file contains no task definitions' END END AS error FROM documents""")
def detect_line_mode(spark, sf):
    i = F.col("doc_id")
    file = F.concat(F.lit("d"), i.cast("string"), F.when(i % 3 == 0, ".txt").when(i % 3 == 1, ".json").otherwise(""))
    first = F.when(i % 5 == 0, F.lit("Wait")).when(i % 5 == 1, F.lit("id=1 instance=a")).when(i % 5 == 2, F.lit("instance=a")) \
        .when(i % 5 == 3, F.concat(F.lit("process="), i.cast("string"))).otherwise(F.lit("# only a comment"))
    lines = table(spark, sf, "documents").select(file.alias("file"), F.posexplode(F.array(
        F.lit(""), F.lit("# head"), first, F.when(i % 5 == 4, F.lit(" ")).otherwise(F.lit("instance=b")))).alias("line_no", "value"))
    return readers.detect_line_mode(lines)


CHECKPOINTS = f"""WITH s AS (SELECT run_id, task_id, id, status, duration_seconds, retry_count, {CKPT_STATE} AS s FROM ex),
 k AS (SELECT run_id, task_id, max_by(s, id) AS state, max_by(duration_seconds, id) AS d, max(id) AS id FROM s GROUP BY run_id, task_id)
 SELECT 'ckpt_' || run_id || '.json' AS checkpoint, 'wf_' || substr(run_id, 10) AS workflow, task_id, state, CASE WHEN state = 'completed' THEN id % 3 > 0 END AS success, NULL AS error
 FROM k WHERE CAST(substr(run_id, 7, 2) AS INTEGER) % 10 <> 0
 UNION ALL SELECT DISTINCT 'ckpt_' || run_id || '.json', NULL, NULL, NULL, NULL::BOOLEAN, 'Checkpoint missing required field: run_started' FROM k WHERE CAST(substr(run_id, 7, 2) AS INTEGER) % 10 = 0"""


@query("read_checkpoints", CHECKPOINTS)
def read_checkpoints(spark, sf):
    parsed = _checkpoint_docs(spark, sf).select("checkpoint", F.from_json("text", CHECKPOINT_DOC).alias("d")).select("checkpoint", "d.*")
    return _checkpoint_rows(*readers.checkpoint_tables(parsed))


@query("read_checkpoint_files", CHECKPOINTS)
def read_checkpoint_files(spark, sf):
    """The documents as JSON files, one a ``folder=…``, read from there."""
    path = scratch(spark)
    _checkpoint_docs(spark, sf).repartition("checkpoint").select(F.col("checkpoint").alias("folder"), "text").write.partitionBy("folder").text(path)
    named = F.regexp_extract("checkpoint", "folder=([^/]+)/", 1)
    return _checkpoint_rows(*[df.withColumn("checkpoint", named) for df in readers.read_checkpoints(spark, path)])


def _checkpoint_rows(good, bad):
    return good.select("checkpoint", "workflow", "task_id", "state", "success", F.lit(None).cast("string").alias("error")) \
        .unionByName(bad, allowMissingColumns=True)


def _checkpoint_docs(spark, sf):
    t = state_of(executions(spark, sf)).groupBy("run_id", "task_id").agg(F.max_by("state", "id").alias("state"), F.max("id").alias("id"))
    day = F.substring("run_id", 7, 2).cast("int")

    def ids(s):
        return F.collect_set(F.when(F.col("state") == s, F.col("task_id"))).alias(f"{s}_tasks")

    entry = F.struct("task_id", F.struct(F.col("task_id"), (F.col("id") % 3 > 0).alias("success")).alias("r"))
    docs = t.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("state") == "completed", entry))).alias("completed_tasks"),
        *[ids(s) for s in ("in_progress", "pending", "failed", "skipped")])
    text = F.to_json(F.struct(
        F.lit("1.0").alias("version"), F.concat(F.lit("tasks/"), "run_id").alias("taskfile_path"),
        F.concat(F.lit("wf_"), F.substring("run_id", 10, 9)).alias("workflow"),
        F.when(day % 10 != 0, F.lit("2024-01-01T00:00:00")).alias("run_started"), F.lit(400).alias("total_tasks"),
        "completed_tasks", "in_progress_tasks", "pending_tasks", "failed_tasks", "skipped_tasks"))
    return docs.select(F.concat(F.lit("ckpt_"), "run_id", F.lit(".json")).alias("checkpoint"), text.alias("text"))


def _input_cells(spark, sf):
    d = definitions(spark, sf).select(
        "workflow", F.lit("Input").alias("run_id"), F.col("id").alias("task_id"), "instance", "process", "chore",
        F.to_json("parameters").alias("parameters"), F.array_join("predecessors", " , ").alias("predecessors"), "stage",
        F.when(F.col("safe_retry"), "Yes").otherwise("").alias("safe_retry"), F.col("timeout").cast("string").alias("timeout"),
        F.when(F.col("pos") % 29 == 0, "1").alias("wait"))
    names = [c for c in d.columns if c not in ("workflow", "run_id", "task_id")]
    cells = d.unpivot(["workflow", "run_id", "task_id"], names, "measure", "value")
    other = cells.withColumn("run_id", F.lit("20240101"))
    return cells.unionByName(other)


@query("cells_to_tasks", """SELECT workflow, id AS task_id, instance, process, chore, CASE WHEN p_seg IS NULL THEN '{}' ELSE '{"pSegment":"' || p_seg || '","pPeriod":"' || p_per || '"}' END AS parameters,
 nullif(array_to_string(preds, ' , '), '') AS predecessors, stage, CASE WHEN safe_retry THEN 'Yes' END AS safe_retry, CAST(timeout AS VARCHAR) AS timeout, CASE WHEN pos % 29 = 0 THEN '1' END AS wait,
 CAST(NULL AS VARCHAR) AS retries, CAST(NULL AS VARCHAR) AS cancel_at_timeout, CAST(NULL AS VARCHAR) AS require_predecessor_success, CAST(NULL AS VARCHAR) AS succeed_on_minor_errors FROM defs""")
def cells_to_tasks(spark, sf):
    return readers.cells_to_tasks(_input_cells(spark, sf))


@query("tasks_from_wide", """WITH n AS (SELECT *, pos % 29 = 0 AS is_wait, sum((pos % 29 = 0)::INTEGER) OVER (PARTITION BY workflow ORDER BY pos) AS sequence FROM defs),
 s AS (SELECT workflow, sequence, count(*) AS size FROM n WHERE NOT is_wait GROUP BY workflow, sequence),
 t AS (SELECT n.*, p.sequence AS previous, p.size AS previous_size FROM n LEFT JOIN s p ON p.workflow = n.workflow AND p.sequence = n.sequence - 1 WHERE NOT is_wait AND pos % 7 <> 3)
 SELECT 'norm' AS mode, workflow, id, instance, process, chore, CASE WHEN p_seg IS NULL THEN '{}' ELSE '{"pSegment": "' || p_seg || '", "pPeriod": "' || p_per || '"}' END AS params,
 '' AS predecessors, previous::BIGINT AS previous, previous_size, stage, safe_retry, timeout, NULL AS error FROM t WHERE NOT (pos % 5 = 2 AND chore IS NULL)
 UNION ALL SELECT 'norm', workflow, id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'Task ''' || id || ''': both ''process'' and ''chore'' are set' FROM t WHERE pos % 5 = 2 AND chore IS NULL
 UNION ALL SELECT 'opt', workflow, id, instance, process, chore, CASE WHEN p_seg IS NULL THEN '{}' ELSE '{"pSegment": "' || p_seg || '", "pPeriod": "' || p_per || '"}' END,
 array_to_string(preds, ','), NULL, NULL, stage, safe_retry, timeout, NULL FROM t WHERE NOT (pos % 5 = 2 AND chore IS NULL)""")
def tasks_from_wide(spark, sf):
    wide = readers.cells_to_tasks(_input_cells(spark, sf)).withColumn("pos", F.col("task_id").cast("long") - 1) \
        .withColumn("instance", F.when(F.col("pos") % 7 == 3, F.lit("  ")).otherwise(F.concat(F.lit(" "), "instance"))) \
        .withColumn("chore", F.when((F.col("pos") % 5 == 2) & F.col("chore").isNull(), "c9").otherwise(F.col("chore")))
    parts = []
    for mode in ("norm", "opt"):
        defs, errors = readers.tasks_from_wide(wide, mode)
        if mode == "opt":
            defs = defs.withColumn("previous", F.lit(None).cast("long")).withColumn("previous_size", F.lit(None).cast("long"))
        parts.append(defs.select(
            F.lit(mode).alias("mode"), "workflow", "id", "instance", "process", "chore", json_map("parameters").alias("params"),
            F.array_join("predecessors", ",").alias("predecessors"), "previous", "previous_size", "stage", "safe_retry", "timeout",
            F.lit(None).cast("string").alias("error")))
        if mode == "norm":
            parts.append(errors.select(F.lit(mode).alias("mode"), "workflow", F.col("task_id").alias("id"), "error"))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2])


# ---- sinks ------------------------------------------------------------------

@query("record_tasks", """SELECT id, run_id, workflow, task_id, task_signature, status, CASE WHEN duration_seconds IS NOT NULL THEN duration_seconds END AS duration_seconds,
 CASE WHEN id % 4 = 0 THEN 0 ELSE retry_count END AS retry_count, error_message, params, pred AS predecessors, safe_retry FROM ex""", dbl="duration_seconds:3")
def record_tasks(spark, sf):
    raw = executions(spark, sf).withColumn("success", F.col("status") == "Success") \
        .withColumn("error_message", F.coalesce("error_message", F.lit("not an error"))) \
        .withColumn("retry_count", F.when(F.col("id") % 4 != 0, F.col("retry_count"))) \
        .withColumn("predecessors", F.coalesce("predecessors", F.array().cast("array<string>"))) \
        .drop("status", "duration_seconds", "task_signature")
    path = scratch(spark)
    writers.append_history(writers.record_tasks(raw), path)
    return readers.read_task_results(spark, path).select(
        "id", "run_id", "workflow", "task_id", "task_signature", "status", "duration_seconds", "retry_count", "error_message",
        json_map("parameters").alias("params"), F.array_join("predecessors", ",").alias("predecessors"), "safe_retry")


@query("start_run", """SELECT run_id, workflow, start_time, CAST(NULL AS VARCHAR) AS status, task_count, max_workers, retries, exclusive, optimize, optimization_algorithm,
 CAST(NULL AS TIMESTAMP) AS end_time, CAST(NULL AS INTEGER) AS success_count FROM runs""", ts="start_time")
def start_run(spark, sf):
    return writers.start_run(runs(spark, sf)).select(
        "run_id", "workflow", "start_time", "status", "task_count", "max_workers", "retries", "exclusive", "optimize",
        "optimization_algorithm", "end_time", "success_count")


@query("export_results_csv", """SELECT run_id, task_id, task_id AS original_task_id, instance, coalesce(process, '') AS process, coalesce(chore, '') AS chore, params AS parameters, status,
 coalesce(duration_seconds, 0) AS duration_seconds, retry_count AS retries, retry_count, coalesce(error_message, '') AS error_message,
 coalesce('["' || pred || '"]', '') AS predecessors, coalesce(stage, '') AS stage, CAST(safe_retry AS VARCHAR) AS safe_retry, coalesce(CAST(timeout AS VARCHAR), '') AS timeout,
 CAST(coalesce(cancel_at_timeout, false) AS VARCHAR) AS cancel_at_timeout FROM ex WHERE workflow = 'wf_1'""", dbl="duration_seconds:3")
def export_results_csv(spark, sf):
    path = scratch(spark)
    writers.write_csv(writers.export_results(executions(spark, sf), workflow="wf_1"), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return back.select("run_id", "task_id", "original_task_id", "instance", text("process"), text("chore"), "parameters", "status",
                       F.col("duration_seconds").cast("double"), F.col("retries").cast("int"), F.col("retry_count").cast("int"),
                       text("error_message"), text("predecessors"), text("stage"), "safe_retry", text("timeout"), "cancel_at_timeout")


@query("export_history_csv", """SELECT id, run_id, workflow, task_id, task_signature, params AS parameters, status, duration_seconds, '["' || pred || '"]' AS predecessors
 FROM ex WHERE workflow = 'wf_2'""", dbl="duration_seconds:3")
def export_history_csv(spark, sf):
    path = scratch(spark)
    writers.write_csv(writers.export_history(executions(spark, sf), workflow="wf_2"), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select(F.col("id").cast("long"), "run_id", "workflow", "task_id", "task_signature", "parameters", "status",
                       F.col("duration_seconds").cast("double"), "predecessors")


@query("results_to_cells", """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY id DESC) AS k FROM res) WHERE k = 1)
 SELECT workflow, run_id, task_id, unnest(['instance', 'process', 'chore', 'parameters', 'status', 'start_time', 'end_time', 'duration_seconds', 'retry_count', 'error_message', 'predecessors',
  'stage', 'safe_retry', 'timeout', 'cancel_at_timeout', 'require_predecessor_success', 'succeed_on_minor_errors', 'original_task_id', 'retries']) AS measure,
 unnest([instance, process, '', params, status, strftime(start_time, '%Y-%m-%d %H:%M:%S'), strftime(end_time, '%Y-%m-%d %H:%M:%S'), printf('%.1f', duration_seconds), CAST(retry_count AS VARCHAR),
  coalesce(error_message, ''), coalesce('["' || array_to_string(preds, '", "') || '"]', ''), coalesce(stage, ''), 'false', '', 'false', 'false', 'false', task_id, CAST(retry_count AS VARCHAR)]) AS value FROM l""")
def results_to_cells(spark, sf):
    return writers.results_to_cells(writers.results_table(results(spark, sf), keep=("id",)))


@query("run_summary_psv", """SELECT run_id, process_runs, process_fails, runtime, overall_success FROM (SELECT run_id, count(*) AS process_runs, count(*) FILTER (status <> 'Success') AS process_fails,
 CAST(epoch_us(max(end_time)) - epoch_us(min(start_time)) AS DOUBLE) / 1000000 AS runtime, count(*) FILTER (status <> 'Success') = 0 AS overall_success FROM ex GROUP BY run_id)""", dbl="runtime")
def run_summary_psv(spark, sf):
    path = scratch(spark)
    writers.write_csv(writers.run_summary(runs(spark, sf), executions(spark, sf)), path, sep="|")
    back = spark.read.option("header", True).option("sep", "|").csv(path)
    return back.select("run_id", F.col("process_runs").cast("long"), F.col("process_fails").cast("long"),
                       F.col("runtime").cast("double"), F.col("overall_success").cast("boolean"))


@query("upload_payload", """SELECT workflow, run_id, task_id, task_id AS original_task_id, instance, coalesce(process, '') AS process, coalesce(chore, '') AS chore,
 CASE WHEN p_seg IS NULL THEN '' ELSE 'pSegment="' || p_seg || '" pPeriod="' || p_per || '" pMode="full"' END AS parameters, status, start_time, end_time,
 coalesce(duration_seconds, 0) AS duration_seconds, retry_count AS retries, retry_count, coalesce(error_message, '') AS error_message, coalesce('["' || pred || '"]', '') AS predecessors,
 coalesce(stage, '') AS stage, safe_retry, coalesce(CAST(timeout AS VARCHAR), '') AS timeout, coalesce(cancel_at_timeout, false) AS cancel_at_timeout,
 require_predecessor_success, succeed_on_minor_errors FROM ex""", dbl="duration_seconds:3", ts="start_time,end_time")
def upload_payload(spark, sf):
    return writers.upload_payload(executions(spark, sf))


@query("taskfile_json_out", f"""WITH e AS (SELECT *, max(pos) OVER (PARTITION BY workflow) AS last FROM defs)
 SELECT workflow, pos AS line, {DEF_JSON} || CASE WHEN pos < last THEN ',' ELSE '' END AS text FROM e
 UNION ALL SELECT workflow, -1, '{{"version": "2.0", "metadata": {{"workflow": "' || workflow || '"}}, "settings": {{}}, "tasks": [' FROM defs GROUP BY workflow
 UNION ALL SELECT workflow, max(pos) + 1, ']}}' FROM defs GROUP BY workflow""")
def taskfile_json_out(spark, sf):
    return writers.taskfile_lines(definitions(spark, sf))


# ---- checks -----------------------------------------------------------------

@query("validate_tasks", """WITH t AS (SELECT *, coalesce(process, '') <> '' AS hp, coalesce(chore, '') <> '' AS hc FROM raw)
 SELECT file, pos, 'required' AS rule, 'Missing required property ''id''' AS message FROM t WHERE coalesce(id, '') = ''
 UNION ALL SELECT file, pos, 'required', 'Missing required property ''instance''' FROM t WHERE coalesce(instance, '') = ''
 UNION ALL SELECT file, pos, 'one_target', '''process'' and ''chore'' are mutually exclusive — exactly one must be set' FROM t WHERE hp AND hc
 UNION ALL SELECT file, pos, 'one_target', 'exactly one of ''process'' or ''chore'' must be set' FROM t WHERE NOT hp AND NOT hc
 UNION ALL SELECT file, pos, 'chore_field', '''parameters'' is not allowed on chore tasks (chores have no invocation parameters)' FROM t WHERE hc AND NOT hp AND has_params
 UNION ALL SELECT file, pos, 'chore_field', '''succeed_on_minor_errors'' is not allowed on chore tasks (chores have no minor-error tier)' FROM t WHERE hc AND NOT hp AND succeed_on_minor_errors
 UNION ALL SELECT file, pos, 'chore_field', '''timeout'' is not allowed on chore tasks (chore execution has no timeout)' FROM t WHERE hc AND NOT hp AND timeout IS NOT NULL
 UNION ALL SELECT file, pos, 'chore_field', '''cancel_at_timeout'' is not allowed on chore tasks (no timeout to cancel)' FROM t WHERE hc AND NOT hp AND cancel_at_timeout
 UNION ALL SELECT file, pos, 'id', '''id'' must be a positive integer. Got: ' || id FROM t WHERE NOT regexp_full_match(id, '[1-9][0-9]*')
 UNION ALL SELECT file, pos, 'timeout', '''timeout'' must be a non-negative integer' FROM t WHERE timeout < 0
 UNION ALL SELECT file, pos, 'predecessor', 'predecessors[' || i || '] must be a positive integer. Got: ' || p FROM (SELECT file, pos, unnest(preds) AS p, unnest(range(len(preds))) AS i FROM t)
   WHERE NOT regexp_full_match(p, '[1-9][0-9]*')""")
def validate_tasks(spark, sf):
    return checks.validate_tasks(faulty_definitions(spark, sf), ["file"])


@query("validate_taskfiles", """WITH d AS (SELECT run_id, CAST(l_n AS BIGINT) AS pos, id FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY n, id) - 1 AS l_n, task_id AS id FROM res)),
 f AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS run_id FROM orders)
 SELECT run_id AS file, 'Missing ''version'' field' AS message FROM f WHERE k % 11 = 0
 UNION ALL SELECT run_id, '''tasks'' array cannot be empty' FROM f WHERE run_id NOT IN (SELECT run_id FROM d)
 UNION ALL SELECT run_id, 'settings.max_workers must be a positive integer' FROM f WHERE k % 7 = 0
 UNION ALL SELECT run_id, 'settings.retries must be a non-negative integer' FROM f WHERE k % 5 = 0
 UNION ALL SELECT run_id, 'Task ' || pos || ': Duplicate task ID ''' || id || '''' FROM d WHERE pos > (SELECT min(pos) FROM d x WHERE x.run_id = d.run_id AND x.id = d.id)""")
def validate_taskfiles(spark, sf):
    from runtally.operators.ordered import numbered
    k = F.col("o_orderkey")
    files = table(spark, sf, "orders").select(
        k.cast("string").alias("file"), F.when(k % 11 != 0, "2.0").alias("version"), F.when(k % 7 == 0, 0).otherwise(4).alias("max_workers"),
        F.when(k % 5 == 0, -1).otherwise(1).alias("retries"))
    r = results(spark, sf)
    defs = numbered(r.select(F.col("run_id").alias("file"), F.col("task_id").cast("int").alias("n"), "id"), ["file"], ["n", "id"], "rn") \
        .select("file", (F.col("rn") - 1).alias("pos"), F.col("n").cast("string").alias("id"))
    return checks.validate_taskfiles(files, defs)


@query("header_contract", """SELECT 'upload_' || o_orderkey AS file, o_orderkey % 3 <> 1 AS valid, CASE WHEN o_orderkey % 3 = 1 THEN 'instance process' ELSE '' END AS mismatched FROM orders""")
def header_contract(spark, sf):
    good = F.array(*[F.lit(c.upper()) for c in UPLOAD_COLUMNS])
    swapped = list(UPLOAD_COLUMNS)
    i, j = swapped.index("instance"), swapped.index("process")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    k = F.col("o_orderkey")
    heads = table(spark, sf, "orders").select(F.concat(F.lit("upload_"), k.cast("string")).alias("file"), F.when(
        k % 3 == 1, F.array(*[F.lit(c) for c in swapped])).otherwise(good).alias("columns"))
    return checks.header_contract(heads)


