from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from runtally.sources import readers, writers
from runtally.streaming import live
from tests.conftest import rows

T0 = datetime(2024, 1, 1)
EVENTS = "run_id string, task_id string, event string, event_time timestamp, success boolean"


def ev(task, event, s, ok=None):
    return ("r", task, event, T0 + timedelta(seconds=s), ok)


def test_late_older_events_change_nothing(spark, tmp_path):
    batches = [[ev("1", "start", 0), ev("2", "start", 1)], [ev("1", "done", 5, True), ev("3", "skip", 2)], [ev("1", "start", 3), ev("2", "done", 1, False)]]
    path = f"{tmp_path}/events"
    spark.createDataFrame([], EVENTS).write.parquet(path)
    stream = live.read_records(spark, path, spark.createDataFrame([], EVENTS).schema)
    q = live.task_state_fold(stream).writeStream.outputMode("complete").format("memory").queryName("state_fold").start()
    try:
        for b in batches:
            spark.createDataFrame(b, EVENTS).write.mode("append").parquet(path)
            q.processAllAvailable()
        got = rows(spark.table("state_fold"), "task_id", "state", "success")
    finally:
        q.stop()
    assert got == [("1", "completed", True), ("2", "completed", False), ("3", "skipped", None)]
    table = live.task_state_fold(spark.createDataFrame([e for b in batches for e in b], EVENTS))
    assert rows(table, "task_id", "state", "success") == got


def test_bursts_settle_once_and_their_state_goes(spark, tmp_path):
    """Repeated and late events change nothing; a burst is given when it is over, and what is kept of it is dropped."""
    path, out, mark = (f"{tmp_path}/{n}" for n in ("events", "out", "mark"))
    first = [ev("1", "start", 0), ev("1", "done", 5, True), ev("2", "start", 1), ev("2", "done", 30, False)]
    batches = [first, first[:2] + [ev("1", "done", 5, True)], [ev("3", "start", 4000)], [ev("1", "done", 2, False), ev("3", "start", 4000)], [ev("4", "start", 20_000)], []]
    spark.createDataFrame([], EVENTS).write.parquet(path)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    kept, settled = [], []
    try:
        q = live.settle(live.read_records(spark, path, spark.createDataFrame([], EVENTS).schema), out, mark, "10 minutes", "1 minute", once=False)
        try:
            for b in batches:
                if b:
                    spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(path)
                q.processAllAvailable()
                kept.append(sum(o["numRowsTotal"] for o in q.lastProgress["stateOperators"]))
                settled.append(spark.read.schema("task_id string, state string, success boolean, events long").parquet(out).count())
        finally:
            q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = rows(spark.read.parquet(out), "task_id", "state", "success", "events")
    assert got == [("1", "completed", True, 2), ("2", "completed", False, 2), ("3", "in_progress", None, 1)]
    assert settled[-1] == 3 and settled[1] == 0 and kept[-1] < kept[0]
    table = live.settled_states(spark.createDataFrame([e for e in batches[0] + batches[1]], EVENTS), "10 minutes")
    assert rows(table, "task_id", "state", "success", "events") == got[:2]


def test_append_equals_batch_and_resumes(spark, tmp_path):
    raw = spark.range(100).select(
        "id", F.lit("r").alias("run_id"), F.concat(F.lit("w"), (F.col("id") % 3).cast("string")).alias("workflow"), F.col("id").cast("string").alias("task_id"),
        F.lit("srv").alias("instance"), F.lit("p").alias("process"), F.lit(None).cast("string").alias("chore"),
        F.create_map(F.lit("k"), F.col("id").cast("string")).alias("parameters"), (F.col("id") % 4 > 0).alias("success"),
        F.lit(T0).alias("start_time"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 1000).alias("end_time"),
        F.lit("e").alias("error_message"), F.lit(0).alias("retry_count"), F.array().cast("array<string>").alias("predecessors"))
    land, out, mark = (f"{tmp_path}/{n}" for n in ("land", "out", "mark"))
    for part in ("id < 60", "id >= 60"):
        raw.filter(part).write.mode("append").parquet(land)
        live.history_append(live.read_records(spark, land, raw.schema), out, mark).awaitTermination()
    cols = ("id", "workflow", "task_signature", "status", "duration_seconds", "error_message")
    assert rows(readers.read_task_results(spark, out), *cols) == rows(writers.record_tasks(raw), *cols)
