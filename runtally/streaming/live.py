"""History kept up to date from streams of task events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from runtally.sources.writers import record_tasks

STATES = {"start": "in_progress", "done": "completed", "skip": "skipped"}


def task_state_fold(events: DataFrame) -> DataFrame:
    """Current state per (run, task) from ``(run_id, task_id, event, event_time, success)``.

    The newest event wins, so a late older one changes nothing. The same plan serves a
    table and a stream in update mode; it keeps one row of state per task.
    """
    state, order = _state(), _order()
    return events.groupBy("run_id", "task_id").agg(
        F.max_by(F.struct(state.alias("state"), "success"), order).alias("s"),
        F.max("event_time").alias("updated"), F.count("*").alias("events")).select(
        "run_id", "task_id", "s.state", "s.success", "updated", "events")


def _state():
    return F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv])[F.col("event")]


def _order():
    """At one instant an ending outranks a start, and a success a failure."""
    return F.struct("event_time", F.when(F.col("event") == "start", 0).otherwise(1).alias("rank"), F.coalesce("success", F.lit(False)).alias("good"))


#: What makes two events the same.
EVENT = ("run_id", "task_id", "event", "event_time", "success")


def settled_states(events: DataFrame, quiet: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Final state of every burst of events of a (run, task): (run_id, task_id, begun, state, success, updated, events).

    A burst is over once nothing has come for ``quiet``; its row is then given, once, and its state dropped. Repeated events count
    once. Events later than ``late`` behind the newest one change nothing. For a stream in append mode, whose state holds the open bursts and
    the events of the last ``late`` only; over a table, all bursts are over.
    """
    timed = events.where("event_time IS NOT NULL").withWatermark("event_time", late)
    once = timed.dropDuplicatesWithinWatermark(list(EVENT)) if events.isStreaming else timed.dropDuplicates(list(EVENT))
    bursts = once.groupBy("run_id", "task_id", F.session_window("event_time", quiet).alias("burst"))
    return bursts.agg(F.max_by(F.struct(_state().alias("state"), "success"), _order()).alias("s"), F.max("event_time").alias("updated"), F.count("*").alias("events")).select(
        "run_id", "task_id", F.col("burst.start").alias("begun"), "s.state", "s.success", "updated", "events")


def settle(events: DataFrame, path: str, checkpoint: str, quiet: str = "1 hour", late: str = "10 minutes", once: bool = True) -> StreamingQuery:
    """Append the states of bursts that are over to a table."""
    out = settled_states(events, quiet, late).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def history_append(raw: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Enrich a stream of execution records and append it to the history table."""
    out = record_tasks(raw).writeStream.format("parquet").outputMode("append") \
        .option("path", path).option("checkpointLocation", checkpoint).partitionBy("workflow")
    return (out.trigger(availableNow=True) if once else out).start()


def read_records(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Stream of parquet files as they land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
