"""Contention and concurrency analysis for every workflow in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from runtally.functions.scalars import fan_out_key, natural_key, round_to_5, rounded, success
from runtally.operators.history import of_runs, run_task_stats
from runtally.operators.joins import chain_edges, latest_snapshot, overlap_count
from runtally.operators.ordered import match
from runtally.operators.windows import best_worst_level, ewma, heavy_outliers, heavy_rank
from runtally.schemas import CONTENTION_WARNINGS
from runtally.session import cut

WF = ["workflow"]


# ---- parameters -------------------------------------------------------------

def latest_task_params(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks of each workflow's newest successful run with their parameters."""
    newest = latest_snapshot(runs).select("run_id")
    return tasks.join(newest, "run_id", "left_semi").select(
        "workflow", "task_id", "task_signature", F.coalesce("parameters", F.create_map().cast("map<string,string>"))
        .alias("parameters"), F.struct(natural_key("task_id").alias("k"), F.col("id")).alias("pos"))


def with_ewma(task_params: DataFrame, estimates: DataFrame) -> DataFrame:
    return task_params.join(estimates.select("task_signature", "ewma"), "task_signature", "left")


def varying_parameters(task_params: DataFrame) -> DataFrame:
    """Parameters with more than one value among a workflow's tasks."""
    return task_params.select("workflow", F.explode("parameters").alias("key", "value")) \
        .groupBy("workflow", "key").agg(F.count_distinct("value").alias("distinct_values")) \
        .filter("distinct_values > 1")


def parameter_groups(task_params: DataFrame, keys: DataFrame) -> DataFrame:
    """Average estimate per value of each given parameter; a task without it has value ''."""
    lists = keys.groupBy("workflow").agg(F.collect_set("key").alias("_keys"))
    return match(task_params, lists, WF).select(
        "workflow", F.explode("_keys").alias("key"), "parameters", "ewma") \
        .select("workflow", "key", F.coalesce(F.col("parameters")[F.col("key")], F.lit("")).alias("value"), "ewma") \
        .groupBy("workflow", "key", "value").agg(
            F.avg("ewma").alias("avg_estimate"), F.count("*").alias("task_count"))


def parameter_impact(groups: DataFrame) -> DataFrame:
    """How far the group averages of a parameter lie apart; groups without estimates do not count."""
    return groups.filter("avg_estimate IS NOT NULL").groupBy("workflow", "key").agg(
        F.count("*").alias("distinct_values"),
        (F.max("avg_estimate") - F.min("avg_estimate")).alias("range_seconds"))


def _ranked(impact: DataFrame) -> DataFrame:
    w = Window.partitionBy("workflow").orderBy(F.desc("range_seconds"), "key")
    return impact.withColumn("rn", F.row_number().over(w))


def contention_driver(impact: DataFrame, min_ratio: float = 5.0) -> DataFrame:
    """The parameter with the widest range, if it beats the runner-up by ``min_ratio``."""
    top = _ranked(impact).filter("rn <= 2").groupBy("workflow").agg(
        F.max(F.when(F.col("rn") == 1, F.col("key"))).alias("widest"),
        F.max(F.when(F.col("rn") == 1, F.col("range_seconds"))).alias("range_seconds"),
        F.max(F.when(F.col("rn") == 2, F.col("range_seconds"))).alias("runner_up"))
    unclear = (F.col("runner_up") > 0) & (F.try_divide("range_seconds", "runner_up") < min_ratio)
    return top.withColumn("driver", F.when(~F.coalesce(unclear, F.lit(False)), F.col("widest")))


def fan_out(task_params: DataFrame, varying: DataFrame, drivers: DataFrame) -> DataFrame:
    """The other varying parameters of a workflow and how many combinations of them occur."""
    others = match(varying.select("workflow", "key"), drivers.select("workflow", "driver"), WF) \
        .filter("driver IS NOT NULL").groupBy("workflow").agg(
            F.array_sort(F.collect_set(F.when(F.col("key") != F.col("driver"), F.col("key")))).alias("fan_out_keys"))
    return match(task_params, others, WF) \
        .groupBy("workflow", "fan_out_keys").agg(
            F.count_distinct(fan_out_key("parameters", "fan_out_keys")).alias("fan_out_size"))


def contention_groups(groups: DataFrame, drivers: DataFrame, sensitivity: float = 10.0) -> DataFrame:
    """Tasks grouped by the driver's value, heavy ones marked."""
    own = match(groups, drivers.filter("driver IS NOT NULL").select("workflow", "driver", F.col("driver").alias("key")),
                ["workflow", "key"])
    avgs = own.select("workflow", "driver", F.col("value").alias("driver_value"), "task_count",
                      F.coalesce("avg_estimate", F.lit(0.0)).alias("avg_duration"))
    return heavy_outliers(avgs, WF, sensitivity)


def recommend_workers(groups: DataFrame, fan: DataFrame) -> DataFrame:
    """Workers for the chains plus those that finish the light work meanwhile."""
    heavy = F.col("is_heavy")
    per = groups.groupBy("workflow").agg(
        F.count_if(heavy).alias("heavy_groups"), F.count_if(~heavy).alias("light_groups"),
        F.coalesce(F.sum(F.when(heavy, F.col("task_count"))), F.lit(0)).alias("heavy_tasks"),
        F.coalesce(F.sum(F.when(~heavy, F.col("task_count"))), F.lit(0)).alias("light_tasks"),
        F.coalesce(F.sum(F.when(heavy, F.col("avg_duration"))), F.lit(0.0)).alias("critical_path"),
        F.coalesce(F.sum(F.when(~heavy, F.col("avg_duration") * F.col("task_count"))), F.lit(0.0)).alias("light_work"))
    return match(per, fan, WF).withColumn("light_slots", light_slots()).withColumn(
        "recommended_workers", F.when(F.col("heavy_groups") < 2, F.col("fan_out_size"))
        .otherwise(F.greatest(F.col("fan_out_size"), F.col("fan_out_size") + F.col("light_slots"))))


def light_slots() -> Column:
    path = F.when(F.col("heavy_groups") > 0, F.col("critical_path")).otherwise(F.lit(1.0))
    return F.when(path > 0, F.ceil(F.col("light_work") / path)).otherwise(F.lit(0))


# ---- concurrency ------------------------------------------------------------

def _level_runs(runs: DataFrame) -> DataFrame:
    """Newest successful run at each number of workers."""
    return runs.filter(success() & F.col("max_workers").isNotNull() & F.col("duration_seconds").isNotNull()) \
        .groupBy("workflow", "max_workers").agg(
            F.max_by(F.struct("run_id", "duration_seconds"), F.struct("start_time", "run_id")).alias("r")) \
        .select("workflow", "max_workers", "r.run_id", F.col("r.duration_seconds").alias("wall_clock"))


def worker_levels(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Newest successful run at each number of workers and how well it used them."""
    chosen = _level_runs(runs)
    return _levels(chosen, run_task_stats(of_runs(tasks, chosen)))


def _levels(chosen: DataFrame, stats: DataFrame) -> DataFrame:
    eff = F.try_divide("total_duration", "wall_clock")
    return chosen.join(stats, "run_id").select(
        "workflow", "max_workers", "run_id", "wall_clock", F.col("total_duration").alias("total_task_time"),
        "task_count", F.col("avg_duration").alias("avg_task_duration"),
        rounded(eff, 1).alias("effective_parallelism"), rounded(F.try_divide(eff, F.col("max_workers")), 3).alias("efficiency"))


def concurrency_correlation(tasks: DataFrame) -> DataFrame:
    """Pearson r of overlap count and duration per run, 0 for under three tasks or no variance."""
    x, y = F.col("concurrent_count").cast("double"), F.col("duration_seconds")
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(y))
    return overlap_count(tasks).groupBy("run_id").agg(
        F.count("*").alias("n"),
        F.when(F.count("*") < 3, F.lit(0.0)).otherwise(F.coalesce(r, F.lit(0.0))).alias("correlation"))


def concurrency_ceiling(runs: DataFrame, tasks: DataFrame, min_correlation: float = 0.7,
                        max_efficiency: float = 0.75) -> DataFrame:
    """Too many or too few workers, from runs at several levels or from the newest run alone."""
    newest = cut(runs.filter(success()).groupBy("workflow").agg(F.max_by(
        F.struct("run_id", "max_workers", "duration_seconds"), F.struct("start_time", "run_id")).alias("r"))
        .select("workflow", F.col("r.run_id").alias("run_id"), F.col("r.max_workers").alias("now_workers"),
                F.col("r.duration_seconds").alias("now_wall")))
    chosen = cut(_level_runs(runs))
    # One pass over the history brings the tasks of all runs looked at.
    looked_at = chosen.select("run_id").unionByName(newest.select("run_id")).distinct()
    few = cut(of_runs(tasks, looked_at).select(
        "id", "run_id", "task_id", "status", "start_time", "end_time", "duration_seconds"))
    stats = cut(run_task_stats(few))
    levels = cut(_levels(chosen, stats))
    pair = best_worst_level(levels).filter("levels >= 2")
    row = F.struct("max_workers", "wall_clock")
    around = match(levels, pair.select("workflow", F.col("best.wall_clock").alias("_bw")), WF) \
        .join(newest.select("workflow", F.col("run_id").alias("_now")), "workflow", "left") \
        .groupBy("workflow").agg(
            F.min_by(F.when(F.col("wall_clock") <= F.col("_bw") * 1.10, row),
                     F.when(F.col("wall_clock") <= F.col("_bw") * 1.10, F.col("max_workers"))).alias("sweet"),
            F.max(F.when(F.col("run_id") == F.col("_now"), row)).alias("current"))
    single = newest.join(stats, "run_id", "left") \
        .join(concurrency_correlation(of_runs(few, newest)).select("run_id", F.col("n").alias("_n"), "correlation"), "run_id", "left")
    t = match(match(single, pair, WF, "left"), around, WF, "left")

    best, worst, now = F.col("best"), F.col("worst"), F.col("now_workers")
    here = F.coalesce("current", F.struct(worst["max_workers"], worst["wall_clock"]))
    fewer = best["max_workers"] < worst["max_workers"]
    up = ((best["max_workers"] > worst["max_workers"]) & (best["max_workers"] > now)
          & (F.col("sweet")["max_workers"] > now))
    eff = F.try_divide("total_duration", "now_wall")
    usage = F.try_divide(eff, now)
    alone = ((F.col("now_wall") > 0) & (F.col("_n") >= 5) & (F.col("correlation") >= min_correlation)
             & (usage < max_efficiency) & (round_to_5(eff) < now))
    kind = F.when(fewer, "multi_run").when(up, "scale_up").when(alone, "single_run")
    workers = (F.when(kind == "multi_run", round_to_5(best["effective_parallelism"]))
               .when(kind == "scale_up", F.col("sweet")["max_workers"])
               .when(kind == "single_run", round_to_5(eff)))
    slow = F.when(kind == "multi_run", worst["wall_clock"]).when(kind == "scale_up", here["wall_clock"])
    fast = F.when(kind == "multi_run", best["wall_clock"]).when(kind == "scale_up", F.col("sweet")["wall_clock"])
    one = kind == "single_run"
    return t.select(
        "workflow", workers.alias("ceiling_workers"), kind.alias("confidence"),
        rounded(slow - fast, 1).alias("wall_clock_improvement"),
        rounded(F.try_divide(slow - fast, slow) * 100, 1).alias("wall_clock_improvement_pct"),
        F.when(one, rounded("correlation", 4)).alias("correlation"),
        F.when(one, rounded(usage, 3)).alias("efficiency")).filter("confidence IS NOT NULL")


# ---- report -----------------------------------------------------------------

@dataclass
class Contention:
    """Frames of one analysis, each keyed by workflow."""

    task_params: DataFrame
    estimates: DataFrame
    varying: DataFrame
    impact: DataFrame
    drivers: DataFrame
    fan: DataFrame
    groups: DataFrame
    chain_order: DataFrame
    chains: DataFrame
    workers: DataFrame


def analyze(runs: DataFrame, tasks: DataFrame, sensitivity: float = 10.0, lookback: int = 10,
            alpha: float = 0.3, min_ratio: float = 5.0) -> Contention:
    """Find the driving parameter, its heavy groups and the chains between them.

    The newest run's tasks with their estimates are checkpointed: everything after that
    works on this small table and not on the history again. The later steps have a few
    rows per workflow and are checkpointed too, as several others read each of them.
    """
    estimates = ewma(tasks, lookback, alpha)
    tp = cut(with_ewma(latest_task_params(runs, tasks), estimates))
    varying = cut(varying_parameters(tp))
    by_value = cut(parameter_groups(tp, varying))
    impact = cut(parameter_impact(by_value))
    drivers = cut(contention_driver(impact, min_ratio))
    fan = cut(fan_out(tp, varying, drivers))
    groups = cut(contention_groups(by_value, drivers, sensitivity))
    workers = cut(recommend_workers(groups, fan))
    enough = workers.filter("heavy_groups >= 2").select("workflow")
    order = heavy_rank(groups.join(enough, "workflow", "left_semi"), WF)
    chains = chain_edges(tp, order, fan.select("workflow", "fan_out_keys"))
    return Contention(tp, estimates, varying, impact, drivers, fan, groups, order, chains, workers)


def contention_report(runs: DataFrame, tasks: DataFrame, sensitivity: float = 10.0, **kw) -> DataFrame:
    """One row per workflow: driver, fan-out, heavy groups, ceiling, workers and the warning."""
    a = analyze(runs, tasks, sensitivity, **kw)
    # A workflow is known if a signature it uses has succeeded somewhere.
    used = cut(tasks.groupBy("workflow", "task_signature").agg(F.count_if(success()).alias("good")))
    won = used.groupBy("task_signature").agg(F.sum("good").alias("_won")).filter("_won > 0")
    t = used.join(won, "task_signature", "left").groupBy("workflow").agg(F.bool_or(F.col("_won").isNotNull()).alias("_known"))
    has_tasks = a.task_params.groupBy("workflow").agg(F.lit(True).alias("_tasks"))
    has_keys = a.varying.groupBy("workflow").agg(F.lit(True).alias("_keys"))
    ranges = _ranked(a.impact).filter("rn <= 3").groupBy("workflow").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "key", "range_seconds"))),
        lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.1f", x["range_seconds"]), F.lit("s"))), ", ").alias("_ranges"))
    links = a.chains.groupBy("workflow").agg(F.count_distinct("task_id").alias("chained_tasks"))
    ceiling = concurrency_ceiling(runs, tasks).select("workflow", "ceiling_workers", F.col("confidence").alias("ceiling_kind"))
    for part in (has_tasks, has_keys, a.drivers.select("workflow", "driver"), a.workers, ranges, links, ceiling):
        t = match(t, part, WF, "left")

    off = F.lit(False)
    case = (F.when(~F.coalesce("_known", off), "no_history").when(~F.coalesce("_tasks", off), "no_tasks")
            .when(~F.coalesce("_keys", off), "no_varying").when(F.col("driver").isNull(), "no_driver")
            .when(F.col("heavy_groups") < 2, "few_heavy").otherwise("chains"))
    looks = F.col("_case").isin("no_varying", "no_driver", "chains")
    top = F.when(looks, F.col("ceiling_workers"))
    own = F.coalesce("recommended_workers", F.lit(0))
    kind = F.when(looks, F.col("ceiling_kind"))
    workers = (F.when(F.col("_case") == "chains", F.when(kind == "scale_up", F.greatest(own, top))
                      .when(kind.isNotNull(), F.least(own, top)).otherwise(own))
               .when(F.col("_case") == "few_heavy", own).otherwise(F.coalesce(top, F.lit(0))))
    text = CONTENTION_WARNINGS
    unclear = F.lit(text["no_driver"])
    warning = (F.when(F.col("_case").isin("no_history", "no_tasks", "no_varying"), F.create_map(*[
                   F.lit(x) for k in ("no_history", "no_tasks", "no_varying") for x in (k, text[k])])[F.col("_case")])
               .when(F.col("_case") == "no_driver", F.when(F.col("_ranges").isNotNull(), F.concat(
                   unclear, F.lit(" (ranges: "), F.col("_ranges"), F.lit(")"))).otherwise(unclear))
               .when(F.col("_case") == "few_heavy", F.format_string(text["few_heavy"], F.col("heavy_groups"))))
    zero = F.lit(0)
    return t.withColumn("_case", case).select(
        "workflow", F.col("driver").alias("contention_driver"),
        F.coalesce(F.array_join("fan_out_keys", ","), F.lit("")).alias("fan_out_keys"),
        F.coalesce("fan_out_size", zero).alias("fan_out_size"),
        F.coalesce("heavy_groups", zero).alias("chain_length"),
        F.coalesce("heavy_tasks", zero).alias("heavy_task_count"),
        F.coalesce("light_tasks", zero).alias("light_task_count"),
        F.coalesce(rounded("critical_path", 1), F.lit(0.0)).alias("critical_path_seconds"),
        F.coalesce("chained_tasks", zero).alias("chained_tasks"), workers.cast("long").alias("recommended_workers"),
        top.alias("concurrency_ceiling"), kind.alias("ceiling_kind"), warning.alias("warning"))


def optimization_choice(report: DataFrame) -> DataFrame:
    """Which task file a workflow gets: chains, a worker limit, or longest-first order."""
    has_ceiling = F.col("concurrency_ceiling").isNotNull()
    choice = (F.when(F.col("contention_driver").isNull() & ~has_ceiling, "longest_first")
              .when(F.col("chained_tasks") > 0, "chains").when(has_ceiling, "ceiling").otherwise("longest_first"))
    return report.select("workflow", choice.alias("choice"), "recommended_workers")
