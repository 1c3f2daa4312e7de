"""Summaries of a growing history from states of its batches: a report reads the states and not the history.

A state has one row for each workflow with counts and moments, and one for each distinct run and task signature of it. States of
any batches merge by the same aggregation, in any order and grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from runtally.functions.scalars import rate, rounded, success
from runtally.operators.history import zero_if_null

STATE = ("kind string, workflow string, member string, n long, good long, timed long, total double, least double, most double, "
         "first_start timestamp, last_start timestamp")
_KEYS = ("kind", "workflow", "member")


def states(tasks: DataFrame) -> DataFrame:
    """The state of a batch of task rows. Rows of one batch must not be in another."""
    member = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("member"))
    kinds = F.array(member("workflow", F.lit(None)), member("run", F.col("run_id")), member("task", F.col("task_signature")))
    d = F.when(success(), F.col("duration_seconds"))
    rows = tasks.select("workflow", "start_time", success().alias("_good"), d.alias("_d"), F.inline(kinds))
    own = F.col("kind") == "workflow"
    return rows.groupBy(*_KEYS).agg(
        F.count_if(own).alias("n"), F.count_if(own & F.col("_good")).alias("good"), F.count(F.when(own, F.col("_d"))).alias("timed"),
        F.sum(F.when(own, F.col("_d"))).alias("total"), F.min(F.when(own, F.col("_d"))).alias("least"), F.max(F.when(own, F.col("_d"))).alias("most"),
        F.min(F.when(own, F.col("start_time"))).alias("first_start"), F.max(F.when(own, F.col("start_time"))).alias("last_start"))


def merged(parts: DataFrame) -> DataFrame:
    """One state of all batches."""
    return parts.groupBy(*_KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "timed", "total")], F.min("least").alias("least"), F.max("most").alias("most"),
        F.min("first_start").alias("first_start"), F.max("last_start").alias("last_start"))


def append_state(tasks: DataFrame, path: str) -> None:
    """Add the state of a batch to those in ``path``."""
    states(tasks).write.mode("append").parquet(path)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    return merged(spark.read.schema(STATE).parquet(path))


def _totals(kind):
    return [F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.count_distinct(F.when(kind == "run", F.col("member"))).alias("run_count"),
            F.count_distinct(F.when(kind == "task", F.col("member"))).alias("unique_tasks"), F.min("first_start").alias("first_start"),
            F.max("last_start").alias("last_start"), rate(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("success_rate")]


def history_stats(state: DataFrame) -> DataFrame:
    """``history.history_stats`` of all rows whose states were merged."""
    return state.agg(*_totals(F.col("kind")), F.count_distinct(F.when(F.col("kind") == "workflow", F.col("workflow"))).alias("workflow_count"))


def workflow_stats(state: DataFrame) -> DataFrame:
    """``history.workflow_stats`` of all rows whose states were merged."""
    mean = F.when(F.sum("timed") > 0, F.sum("total") / F.sum("timed"))
    return state.groupBy("workflow").agg(
        *_totals(F.col("kind")), zero_if_null(rounded(mean, 2)).alias("avg_duration"),
        zero_if_null(rounded(F.min("least"), 2)).alias("min_duration"), zero_if_null(rounded(F.max("most"), 2)).alias("max_duration"))
