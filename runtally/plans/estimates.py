"""Runtime estimates and the per-workflow analysis report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from runtally.functions import folds
from runtally.functions.scalars import rounded, short_label
from runtally.operators.joins import with_defaults
from runtally.operators.ordered import match
from runtally.operators.windows import default_estimate, duration_lists, nonzero
from runtally.session import cut


def signature_history(tasks: DataFrame, n: int = 10, alpha: float = 0.3) -> DataFrame:
    """Statistics over the newest ``n`` successes of each signature; zero durations do not count."""
    d = duration_lists(tasks, n).withColumn("d", nonzero(F.col("durations")))
    d = d.withColumn("avg", folds.mean(F.col("d"))).withColumn("std", folds.sample_std(F.col("d")))
    return d.select("task_signature", "task_id", "history_count", F.size("d").alias("sample_count"),
                    folds.ewma(F.col("d"), alpha).alias("ewma"), "avg", "std",
                    folds.spread(F.col("std"), F.col("avg")).alias("cv"))


def per_workflow(tasks: DataFrame, history: DataFrame) -> DataFrame:
    """History statistics of every signature a workflow uses.

    Checkpointed: it has one row per signature and workflow, and the reports read it
    several times, which must not scan the history again.
    """
    signatures = tasks.select("workflow", "task_signature").distinct()
    return cut(signatures.join(history, "task_signature", "left"))


def runtime_estimates(tasks: DataFrame, n: int = 10, alpha: float = 0.3) -> DataFrame:
    """Estimate, samples and confidence per workflow and signature; the default where none are known."""
    h = signature_history(tasks, n, alpha)
    h = h.withColumn("confidence", folds.confidence(F.col("sample_count"), F.col("cv")))
    all_ = per_workflow(tasks, h)
    known = F.coalesce(F.col("sample_count"), F.lit(0)) > 0
    defaults = default_estimate(all_.withColumn("ewma", F.when(known, F.col("ewma"))))
    return match(all_, defaults, ["workflow"], "left").select(
        "workflow", "task_signature", F.when(known, F.col("ewma")).otherwise(F.col("default_estimate")).alias("ewma"),
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.when(known, F.col("confidence")).otherwise(F.lit(0.0)).alias("confidence"), (~known).alias("estimated"))


def analyze_runs(tasks: DataFrame, n: int = 10, alpha: float = 0.3) -> DataFrame:
    """Report rows per workflow and signature.

    A single sample counts as steady here. Signatures without any success take the
    default estimate; those whose successes all lasted zero seconds are left out.
    """
    all_ = per_workflow(tasks, signature_history(tasks, n, alpha))
    cv = F.when(F.col("sample_count") > 1, F.col("cv")).otherwise(F.lit(0.0))
    conf = folds.quantity_factor(F.col("history_count")) + (1 - F.least(F.lit(1.0), cv)) * 0.5
    seen = all_.filter("sample_count > 0").select(
        "workflow", "task_signature", "task_id", F.col("avg").alias("avg_duration"), "ewma",
        F.col("history_count").alias("run_count"), F.lit(1.0).alias("success_rate"), conf.alias("confidence"),
        F.col("std").alias("std_dev"), cv.alias("cv"), F.lit(False).alias("estimated"))
    unseen = all_.filter("history_count IS NULL").select("workflow", "task_signature")
    defaults = default_estimate(all_.filter("sample_count > 0 OR history_count IS NULL"))
    zero = F.lit(0.0)
    missing = match(unseen, defaults, ["workflow"], "left").select(
        "workflow", "task_signature", F.col("task_signature").alias("task_id"),
        F.col("default_estimate").alias("avg_duration"), F.col("default_estimate").alias("ewma"),
        F.lit(0).alias("run_count"), zero.alias("success_rate"), zero.alias("confidence"),
        zero.alias("std_dev"), zero.alias("cv"), F.lit(True).alias("estimated"))
    return seen.unionByName(missing)


def estimates_with_defaults(tasks: DataFrame, n: int = 10, alpha: float = 0.3) -> DataFrame:
    all_ = per_workflow(tasks, signature_history(tasks, n, alpha))
    seen = all_.filter("sample_count > 0").select("workflow", "task_signature", "ewma")
    unseen = all_.filter("history_count IS NULL").select("workflow", "task_signature")
    return with_defaults(seen, unseen, default_estimate(all_.filter("sample_count > 0 OR history_count IS NULL")))


def confidence_summary(report: DataFrame) -> DataFrame:
    """Tasks with and without history, average confidence and how many are at least 0.8."""
    has = ~F.col("estimated")
    return report.groupBy("workflow").agg(
        F.count("*").alias("tasks"), F.count_if(has).alias("with_history"),
        F.count_if(~has).alias("estimated"), F.avg(F.when(has, F.col("confidence"))).alias("avg_confidence"),
        F.count_if(has & (F.col("confidence") >= 0.8)).alias("high_confidence"),
        F.max("run_count").alias("runs_analyzed"))


def recommendations(report: DataFrame) -> DataFrame:
    """Tasks with low confidence, without history, and above twice the mean estimate."""
    report = cut(report)
    totals = report.groupBy("workflow").agg(
        F.count_if(~F.col("estimated") & (F.col("confidence") < 0.5)).alias("low_confidence"),
        F.count_if("estimated").alias("no_history"), F.avg("ewma").alias("mean_estimate"))
    slow = match(report, totals.select("workflow", "mean_estimate"), ["workflow"]) \
        .filter(F.col("ewma") > F.col("mean_estimate") * 2)
    counts = slow.groupBy("workflow").agg(F.count("*").alias("slow_tasks"))
    w = Window.partitionBy("workflow").orderBy("estimated", "task_signature")
    labels = slow.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 5").groupBy("workflow").agg(
        F.array_sort(F.collect_list(F.struct("_rn", short_label("task_id", 16, 16).alias("label")))).alias("l"))
    out = match(match(totals, counts, ["workflow"], "left"), labels, ["workflow"], "left")
    return out.select("workflow", "low_confidence", "no_history", rounded("mean_estimate", 4).alias("mean_estimate"),
                      F.coalesce("slow_tasks", F.lit(0)).alias("slow_tasks"),
                      F.coalesce(F.array_join(F.col("l.label"), ", "), F.lit("")).alias("slow_labels"))
