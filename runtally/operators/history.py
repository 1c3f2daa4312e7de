"""Filters, deletes-as-filters and aggregations over run history.

``tasks`` and ``runs`` are DataFrames of ``schemas.TASKS`` and ``schemas.RUNS``. What a
lookup would take as an argument is a grouping key here, so one job answers for every
workflow, run or task signature.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from runtally.functions.scalars import json_entries, rate, rounded, seconds_between, success, target_of
from runtally.operators.ordered import MIDDLES, QUARTILES, histogram, match, numbered, order_statistics
from runtally.schemas import STAGE_ORDER, task_order

ok = lambda: F.count_if(success())


def zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


# ---- filters ----------------------------------------------------------------

def with_target(tasks: DataFrame) -> DataFrame:
    return tasks.select("*", *target_of())


def failures(tasks: DataFrame) -> DataFrame:
    """Executions that did not succeed."""
    return with_target(tasks.filter(~success())).select(
        "task_id", F.coalesce("process", F.lit("")).alias("process"),
        F.coalesce("chore", F.lit("")).alias("chore"), "task_target", "task_kind", "instance",
        "run_id", zero_if_null(rounded("duration_seconds", 2)).alias("duration"), "error_message")


def retain(runs: DataFrame, tasks: DataFrame, days: int,
           now: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs and tasks younger than ``days`` (0 keeps all) and the runs that go."""
    if days <= 0:
        return runs, tasks, runs.limit(0)
    cutoff = F.lit(now - timedelta(days=days))
    gone = runs.filter(F.col("start_time") < cutoff)
    kept = runs.filter(~F.coalesce(F.col("start_time") < cutoff, F.lit(False)))
    return kept, tasks.join(gone.select("run_id"), "run_id", "left_anti"), gone


def purge(tasks: DataFrame, *, workflow: str | None = None, run_id: str | None = None,
          before: datetime | None = None) -> DataFrame:
    """Task rows left after deleting one workflow, one run, or everything before a date."""
    hit = _purge_condition(workflow, run_id, before)
    return tasks.limit(0) if hit is None else tasks.filter(~F.coalesce(hit, F.lit(False)))


def purge_count(tasks: DataFrame, *, workflow: str | None = None, run_id: str | None = None,
                before: datetime | None = None) -> DataFrame:
    """Dry run of ``purge``: how many rows would go."""
    hit = _purge_condition(workflow, run_id, before)
    return (tasks if hit is None else tasks.filter(hit)).agg(F.count("*").alias("n"))


def _purge_condition(workflow, run_id, before) -> Column | None:
    if workflow is not None:
        return F.col("workflow") == workflow
    if run_id is not None:
        return F.col("run_id") == run_id
    if before is not None:
        return F.col("start_time") < F.lit(before)
    return None


def search_tasks(tasks: DataFrame, term: str = "", hidden_stages: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose id, target, instance, stage or parameters contain ``term``."""
    pairs = F.transform(F.map_entries("parameters"), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    text = F.lower(F.concat_ws(" ", "task_id", "task_target", "instance", "stage", F.array_join(pairs, " ")))
    shown = text.contains(term.lower())
    if hidden_stages:
        shown = shown & ~F.coalesce(F.col("stage").isin(*hidden_stages), F.lit(False))
    return with_target(tasks).filter(shown)


def normalise_workflow(df: DataFrame) -> DataFrame:
    return df.withColumn("workflow", F.lower(F.coalesce("workflow", F.lit(""))))


def select_workflow(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Runs per wanted workflow, whatever the case; a workflow without runs gives an error row."""
    w = normalise_workflow(wanted).distinct()
    n = normalise_workflow(runs).groupBy("workflow").agg(F.count("*").alias("run_count"))
    return w.join(n, "workflow", "left").select(
        "workflow", F.coalesce("run_count", F.lit(0)).alias("run_count"),
        F.when(F.col("run_count").isNull(),
               F.concat(F.lit("No runs found for workflow: "), F.col("workflow"))).alias("error"))


# ---- totals -----------------------------------------------------------------

def _totals() -> list[Column]:
    return [F.count("*").alias("total_records"),
            F.count_distinct("run_id").alias("run_count"),
            F.count_distinct("task_signature").alias("unique_tasks"),
            F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"),
            rate(ok(), F.count("*")).alias("success_rate")]


def history_stats(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*_totals(), F.count_distinct("workflow").alias("workflow_count"))


def workflow_stats(tasks: DataFrame) -> DataFrame:
    d = F.when(success(), F.col("duration_seconds"))
    return tasks.groupBy("workflow").agg(
        *_totals(),
        zero_if_null(rounded(F.avg(d), 2)).alias("avg_duration"),
        zero_if_null(rounded(F.min(d), 2)).alias("min_duration"),
        zero_if_null(rounded(F.max(d), 2)).alias("max_duration"))


def list_workflows(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("workflow").agg(
        F.count("*").alias("record_count"), F.count_distinct("run_id").alias("run_count"),
        F.count_distinct("task_signature").alias("task_count"),
        F.max("start_time").alias("last_run")).orderBy(F.desc("last_run"))


def newest_runs(runs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest runs of every workflow with their age ``rn``."""
    w = Window.partitionBy("workflow").orderBy(F.desc("start_time"), F.desc("run_id"))
    return runs.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def list_runs(runs: DataFrame, tasks: DataFrame, limit: int = 20) -> DataFrame:
    """Newest runs with counts and times; observed counts stand in for missing header counts."""
    seen = tasks.groupBy("run_id").agg(
        F.sum("duration_seconds").alias("total"), F.count("*").alias("n"), ok().alias("good"))
    task_count = F.when(F.coalesce("task_count", F.lit(0)) == 0, F.coalesce("n", F.lit(0))) \
        .otherwise(F.col("task_count"))
    good = F.coalesce("success_count", "good", F.lit(0))
    return newest_runs(runs, limit).join(seen, "run_id", "left").select(
        "workflow", "run_id", "start_time", "end_time",
        rounded("duration_seconds", 2).alias("duration_seconds"),
        task_count.alias("task_count"), good.alias("success_count"),
        rate(good, task_count).alias("success_rate"),
        zero_if_null(rounded("total", 2)).alias("total_task_duration"))


def list_tasks(tasks: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("task_id", "instance", "process"), task_order(tasks))
    return tasks.groupBy("workflow", "task_signature").agg(
        first.alias("f"), F.count("*").alias("run_count"),
        zero_if_null(rounded(F.avg("duration_seconds"), 2)).alias("avg_duration"),
        rate(ok(), F.count("*")).alias("success_rate")
    ).select("workflow", "task_signature", "f.task_id", "f.instance", "f.process",
             "run_count", "avg_duration", "success_rate")


def workflow_signatures(tasks: DataFrame) -> DataFrame:
    return tasks.select("workflow", "task_signature").distinct().orderBy("workflow", "task_signature")


def sample_count(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_signature").agg(ok().alias("samples"))


def run_task_stats(tasks: DataFrame) -> DataFrame:
    """Total, count and average of successful durations per run."""
    return tasks.filter(success()).groupBy("run_id").agg(
        F.sum("duration_seconds").alias("total_duration"), F.count("*").alias("task_count"),
        F.avg("duration_seconds").alias("avg_duration"))


def run_distribution(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Five-number summary, mean, deviation and outlier count of successful durations per run."""
    d = tasks.filter(success() & F.col("duration_seconds").isNotNull()) \
        .select("run_id", "duration_seconds")
    hist = histogram(d, ["run_id"], "duration_seconds")
    q = order_statistics(hist, ["run_id"], "duration_seconds", {**QUARTILES, **MIDDLES}, moments=True) \
        .withColumn("median", (F.col("mid_low") + F.col("mid_high")) / 2) \
        .withColumn("fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    out = hist.join(q.select("run_id", "fence"), "run_id").filter(F.col("duration_seconds") > F.col("fence")) \
        .groupBy("run_id").agg(F.sum("c").alias("outlier_count"))
    got = q.join(out, "run_id", "left")
    return runs.select("run_id").join(got, "run_id", "left").select(
        "run_id", *[zero_if_null(rounded(c, 2)).alias(c)
                    for c in ("min", "q1", "median", "q3", "max", "mean", "std_dev")],
        F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"))


def _per_task(tasks: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("task_id", "instance", "process", "chore", "task_target", "task_kind"), task_order(tasks))
    d = F.col("duration_seconds")
    return with_target(tasks).groupBy("task_signature").agg(
        first.alias("f"), F.count("*").alias("executions"),
        rate(ok(), F.count("*")).alias("success_rate"),
        zero_if_null(F.avg(d)).alias("avg"), zero_if_null(F.min(d)).alias("min"),
        zero_if_null(F.max(d)).alias("max"), zero_if_null(F.stddev_samp(d)).alias("std"),
    ).select("task_signature", "f.*", "executions", "success_rate", "avg", "min", "max", "std")


def task_summaries(tasks: DataFrame) -> DataFrame:
    return _per_task(tasks).select(
        "task_signature", "task_id", "instance", "process", "chore", "task_target", "task_kind",
        "executions", "success_rate", rounded("avg", 2).alias("avg_duration"),
        rounded("min", 2).alias("min_duration"), rounded("max", 2).alias("max_duration"),
        rounded("std", 2).alias("std_dev")).orderBy(F.desc("avg_duration"))


def of_runs(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Tasks of the given runs."""
    return tasks.join(runs.select("run_id"), "run_id", "left_semi")


def task_table(tasks: DataFrame, runs: DataFrame, n: int = 5) -> DataFrame:
    """Per signature over the last ``n`` runs of each workflow, with its variation."""
    cv = F.when(F.col("avg") > 0, F.col("std") / F.col("avg")).otherwise(F.lit(0.0))
    return _per_task(of_runs(tasks, newest_runs(runs, n))) \
        .withColumn("cv", cv).withColumn("high_cv", F.col("cv") > 0.5)


def workflow_meta(runs: DataFrame, default_runs: int = 5) -> DataFrame:
    newest = F.max_by(F.struct("taskfile_name", "taskfile_description", "taskfile_author"),
                      F.struct("start_time", "run_id"))
    return normalise_workflow(runs).groupBy("workflow").agg(
        newest.alias("m"), F.count("*").alias("run_count")).select(
        "workflow", "m.*", "run_count",
        F.least(F.lit(default_runs), F.col("run_count")).alias("default_runs"))


def summary_cards(runs: DataFrame, n: int = 5) -> DataFrame:
    d = F.when(F.col("duration_seconds") != 0, F.col("duration_seconds"))
    total, good = F.sum(F.coalesce("task_count", F.lit(0))), F.sum(F.coalesce("success_count", F.lit(0)))
    return newest_runs(runs, n).groupBy("workflow").agg(
        F.count("*").alias("runs_shown"), total.alias("total_tasks"), good.alias("total_success"),
        F.max(F.when(F.col("rn") == 1, F.coalesce("task_count", F.lit(0)))).alias("tasks_per_run"),
        rate(good, total).alias("success_rate"), zero_if_null(F.min(d)).alias("best_duration"),
        zero_if_null(F.avg(d)).alias("avg_duration"),
        F.count_distinct(F.when(F.col("max_workers") != 0, F.col("max_workers"))).alias("worker_levels"))


def stage_totals(tasks: DataFrame) -> DataFrame:
    return tasks.filter(F.coalesce("stage", F.lit("")) != "").groupBy("run_id", "stage").agg(
        zero_if_null(rounded(F.sum("duration_seconds"), 2)).alias("total_duration"))


def stage_averages(tasks: DataFrame) -> DataFrame:
    """Average successful duration per stage, known stages in pipeline order."""
    d = F.when(success(), F.col("duration_seconds"))
    place = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), F.lower("stage"))
    return tasks.filter(F.coalesce("stage", F.lit("")) != "").groupBy("stage").agg(
        zero_if_null(rounded(F.avg(d), 2)).alias("avg_duration"), F.count(d).alias("n")
    ).withColumn("place", F.when(place > 0, place)) \
        .orderBy(F.asc_nulls_last("place"), "stage")


def run_status_counts(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    seen = tasks.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(~success()).alias("bad"))
    zero = F.lit(0)
    return runs.join(seen, "run_id", "left").select(
        "run_id", F.coalesce("success_count", zero).alias("success_count"),
        F.coalesce("failure_count", zero).alias("failure_count"),
        F.coalesce("n", zero).alias("task_count_actual"),
        F.coalesce("bad", zero).alias("failure_count_actual"))


def run_clock(tasks: DataFrame) -> DataFrame:
    """Wall clock and summed task time of every run."""
    return tasks.groupBy("run_id").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        seconds_between(F.min("start_time"), F.max("end_time")).alias("wall_seconds"),
        zero_if_null(F.sum("duration_seconds")).alias("task_seconds"),
        ok().alias("success_count"), F.count_if(~success()).alias("failure_count"))


def workflow_drift(runs: DataFrame, now: datetime, days: int = 30) -> DataFrame:
    d = F.col("duration_seconds")
    return runs.filter(F.col("start_time") >= F.lit(now - timedelta(days=days))).groupBy("workflow").agg(
        F.count("*").alias("runs"), F.avg(d).alias("avg_duration"),
        (F.max(d) - F.min(d)).alias("spread")).orderBy(F.desc("spread"))


def result_and(results: DataFrame) -> DataFrame:
    """Outcome per task id: complete when every instance is done, good when all were."""
    done = F.col("state").isin("completed", "failed", "skipped")
    return results.groupBy("run_id", "task_id").agg(
        F.count("*").alias("instances"), F.bool_and(done).alias("complete"),
        F.bool_and(F.when(done, F.col("success"))).alias("success"))


def remaining_by_instance(state: DataFrame) -> DataFrame:
    return state.filter(F.col("state").isin("pending", "running")) \
        .groupBy("run_id", "instance").agg(F.count("*").alias("remaining"))


def checkpoint_progress(state: DataFrame, total: str = "total_tasks") -> DataFrame:
    """Counts and percentage per checkpoint from one row per (checkpoint, task, state)."""
    def n(s: str) -> Column:
        return F.count_if(F.col("state") == s)

    done, all_ = n("completed"), F.max(total)
    return state.groupBy("checkpoint").agg(
        done.alias("completed"), n("in_progress").alias("in_progress"), n("pending").alias("pending"),
        n("failed").alias("failed"), n("skipped").alias("skipped"),
        F.count_if((F.col("state") == "completed") & F.col("success")).alias("success_count"),
        rate(done, all_).alias("progress_percentage"),
        ((n("pending") == 0) & (n("in_progress") == 0)).alias("is_complete"))


def expanded_summary(results: DataFrame) -> DataFrame:
    """One row per (run, task id) over all its instances, whatever their number.

    A task with one instance keeps its row. Of several, the first by start keeps its columns, except status, times, retries and
    the first error there is; ``parameters`` then tells how many there are. ``expanded_details`` lists each instance.
    """
    keys = ["run_id", "task_id"]
    order = F.struct("start_time", "id")
    replaced = ["status", "start_time", "end_time", "duration_seconds", "retry_count", "error_message", "parameters"]
    shared = [c for c in results.columns if c not in (*keys, *replaced)]
    failed = F.when(F.coalesce("error_message", F.lit("")) != "", order)
    rows = results.groupBy(*keys).agg(
        F.min_by(F.struct(*shared, F.map_entries("parameters").alias("_entries")), order).alias("b"), F.count("*").alias("n"), ok().alias("good"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("duration_seconds").alias("_d"),
        F.sum("retry_count").alias("retry_count"), F.max("status").alias("_status"), F.min_by("error_message", failed).alias("error_message"))
    many = F.col("n") > 1
    status = (F.when(~many, F.col("_status")).when(F.col("good") == F.col("n"), "Success")
              .when(F.col("good") == 0, "Fail")
              .otherwise(F.format_string("Partial (%d/%d Success)", F.col("good"), F.col("n"))))
    wall = rounded(seconds_between("start_time", "end_time"), 3)
    return rows.select(
        *keys, *[F.col("b")[c].alias(c) for c in shared], status.alias("status"), "start_time", "end_time",
        F.when(many, F.coalesce(wall, "_d")).otherwise(F.col("_d")).alias("duration_seconds"),
        F.when(many, F.concat(F.lit('{"expanded": '), F.col("n").cast("string"), F.lit("}")))
        .otherwise(json_entries(F.col("b")["_entries"])).alias("parameters"),
        F.coalesce("error_message", F.lit("")).alias("error_message"), "retry_count", F.col("n").alias("instances"))


def expanded_details(results: DataFrame) -> DataFrame:
    """Every instance of every (run, task id) in order of start: its number from 1, parameters and error."""
    keys = ["run_id", "task_id"]
    few = results.select(*keys, "id", "start_time", "parameters", "error_message")
    return numbered(few, keys, ["start_time", "id"], "instance_no").select(
        *keys, "instance_no", json_entries(F.map_entries("parameters")).alias("parameters"), F.coalesce("error_message", F.lit("")).alias("error_message"))
