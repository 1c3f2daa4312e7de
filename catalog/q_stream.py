"""Streaming operators run over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query, scratch
from catalog.tables import executions
from runtally.functions.scalars import json_map
from runtally.sources import readers
from runtally.streaming import live


def _events(tasks):
    """A start and, where it is known, an end event per execution."""
    name = F.when(F.col("status") == "Success", "done").otherwise(F.when(F.col("retry_count") == 0, "skip").otherwise("done"))
    return tasks.select("run_id", "task_id", F.inline(F.array(
        F.struct(F.lit("start").alias("event"), F.col("start_time").alias("event_time"), F.lit(None).cast("boolean").alias("success")),
        F.struct(name.alias("event"), F.col("end_time").alias("event_time"), (F.col("status") == "Success").alias("success"))))) \
        .filter("event_time IS NOT NULL")


@query("task_state_fold", """WITH e AS (SELECT run_id, task_id, 'in_progress' AS state, start_time AS t, NULL::BOOLEAN AS success, 0 AS r FROM ex
 UNION ALL SELECT run_id, task_id, CASE WHEN status <> 'Success' AND retry_count = 0 THEN 'skipped' ELSE 'completed' END, end_time, status = 'Success', 1 FROM ex WHERE end_time IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY t DESC, r DESC) AS k, count(*) OVER (PARTITION BY run_id, task_id) AS n FROM e)
 SELECT run_id, task_id, state, success, t AS updated, n AS events FROM o WHERE k = 1""", ts="updated")
def task_state_fold(spark, sf):
    return live.task_state_fold(_events(executions(spark, sf)))


@query("history_append", """SELECT id, run_id, workflow, task_signature, status, duration_seconds, error_message, params FROM ex""", dbl="duration_seconds:3")
def history_append(spark, sf):
    """Executions land as files, a stream enriches them and appends them to the history."""
    landed, out, mark = scratch(spark), scratch(spark), scratch(spark)
    raw = executions(spark, sf).withColumn("success", F.col("status") == "Success").drop("status", "task_signature", "duration_seconds")
    raw.write.parquet(landed)
    stream = live.read_records(spark, landed, raw.schema)
    live.history_append(stream, out, mark).awaitTermination()
    return readers.read_task_results(spark, out).select(
        "id", "run_id", "workflow", "task_signature", "status", "duration_seconds", "error_message", json_map("parameters").alias("params"))


# A microsecond more than the data's times can differ by, so that no pause is exactly as long.
QUIET = "3600 seconds 1 microsecond"


@query("settled_states", """WITH e AS (SELECT DISTINCT run_id, task_id, 'in_progress' AS state, start_time AS t, NULL::BOOLEAN AS success, 0 AS r FROM ex
 UNION SELECT run_id, task_id, CASE WHEN status <> 'Success' AND retry_count = 0 THEN 'skipped' ELSE 'completed' END, end_time, status = 'Success', 1 FROM ex WHERE end_time IS NOT NULL),
 g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= INTERVAL 3600 SECONDS THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY run_id, task_id ORDER BY t)),
 b AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id, task_id ORDER BY t) AS burst FROM g),
 o AS (SELECT *, row_number() OVER (PARTITION BY run_id, task_id, burst ORDER BY t DESC, r DESC, coalesce(success, false) DESC) AS k,
   count(*) OVER (PARTITION BY run_id, task_id, burst) AS n, min(t) OVER (PARTITION BY run_id, task_id, burst) AS begun FROM b)
 SELECT run_id, task_id, begun, state, success, t AS updated, n AS events FROM o WHERE k = 1""", ts="begun,updated")
def settled_states(spark, sf):
    """Every event lands twice; a stream settles them. A last event, long after, ends all bursts but its own."""
    landed, out, mark = scratch(spark), scratch(spark), scratch(spark)
    events = _events(executions(spark, sf))
    events.write.parquet(landed)
    events.write.mode("append").parquet(landed)
    end = events.agg((F.max("event_time") + F.expr("INTERVAL 400 DAYS")).alias("event_time")).select(
        F.lit("").alias("run_id"), F.lit("").alias("task_id"), F.lit("start").alias("event"), "event_time", F.lit(None).cast("boolean").alias("success"))
    end.write.mode("append").parquet(landed)
    live.settle(live.read_records(spark, landed, events.schema), out, mark, QUIET, "200 days").awaitTermination()
    return spark.read.schema("run_id string, task_id string, begun timestamp, state string, success boolean, updated timestamp, events long").parquet(out)
