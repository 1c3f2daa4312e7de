"""Newest-N selections, ordered folds, timelines, rankings and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from runtally.functions import folds
from runtally.functions.scalars import natural_key, rounded, success
from runtally.operators.history import newest_runs, of_runs, with_target, zero_if_null
from runtally.operators.ordered import (MIDDLES, QUARTILES, histogram, match, numbered,
                                        order_statistics, running_sums)
from runtally.schemas import FALLBACK_ESTIMATE, TASK_KEY, task_order
from runtally.session import cut


def newest_ties(tasks: DataFrame) -> list[Column]:
    """Order of rows that started together, newest first: by id, and rows of the document store by their key."""
    return [F.desc(c) for c in ("id", TASK_KEY) if c in tasks.columns]


def latest_executions(tasks: DataFrame, n: int = 10, keys: Sequence[str] = ("task_signature",)) -> DataFrame:
    """Newest ``n`` successful executions per signature, ``rn`` 1 being the newest."""
    w = Window.partitionBy(*keys).orderBy(F.desc("start_time"), *newest_ties(tasks))
    return tasks.filter(success()).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def task_history(tasks: DataFrame, n: int = 20) -> DataFrame:
    """Newest ``n`` executions of any status per signature."""
    w = Window.partitionBy("task_signature").orderBy(F.desc("start_time"), *newest_ties(tasks))
    return tasks.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).select(
        "task_signature", "rn", "task_id", "instance", "process", "run_id", "start_time", "end_time",
        zero_if_null(rounded("duration_seconds", 2)).alias("duration"), "status")


def last_n_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last ``n`` runs of every workflow, numbered oldest first."""
    shown = newest_runs(runs, n)
    chronological = Window.partitionBy("workflow").orderBy(F.desc("rn"))
    return shown.withColumn("position", F.row_number().over(chronological)).drop("rn")


def duration_lists(tasks: DataFrame, n: int = 10, keys: Sequence[str] = ("task_signature",)) -> DataFrame:
    """Per key the durations of its newest ``n`` successes, newest first (at most ``n`` values)."""
    items = F.array_sort(F.collect_list(F.struct("rn", "duration_seconds", "task_id")))
    return latest_executions(tasks, n, keys).groupBy(*keys).agg(items.alias("h")).select(
        *keys, F.element_at("h", 1)["task_id"].alias("task_id"), F.size("h").alias("history_count"),
        F.filter(F.transform("h", lambda i: i["duration_seconds"]), lambda d: d.isNotNull()).alias("durations"))


def nonzero(durations: Column) -> Column:
    return F.filter(durations, lambda d: d != 0)


def ewma(tasks: DataFrame, n: int = 10, alpha: float = 0.3,
         keys: Sequence[str] = ("task_signature",)) -> DataFrame:
    """Damped moving average of the newest ``n`` successes per key; zero durations count."""
    return duration_lists(tasks, n, keys).select(
        *keys, folds.ewma(F.col("durations"), alpha).alias("ewma")).filter(F.col("ewma").isNotNull())


def confidence(tasks: DataFrame, n: int = 10) -> DataFrame:
    d = duration_lists(tasks, n).withColumn("d", nonzero(F.col("durations")))
    cv = folds.spread(folds.sample_std(F.col("d")), folds.mean(F.col("d")))
    return d.select("task_signature", F.size("d").alias("sample_count"),
                    folds.confidence(F.size("d"), cv).alias("confidence"))


def default_estimate(estimates: DataFrame, keys: Sequence[str] = ("workflow",), value: str = "ewma",
                     out: str = "default_estimate") -> DataFrame:
    """Mean of the fastest quarter (at least one) of the positive estimates per key, else 10.

    Taken from the histogram of estimates, so no key needs its estimates in one task.
    """
    keys = list(keys)
    hist = histogram(estimates.filter(F.col(value) > 0), keys, value)
    n = hist.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.sum("c") / 4)).alias("k"))
    before = F.col("upto") - F.col("c")
    part = match(hist, n, keys).filter(before < F.col("k"))
    taken = F.least(F.col("c"), F.col("k") - before)
    got = part.groupBy(*keys).agg((F.sum(F.col(value) * taken) / F.sum(taken)).alias(out))
    return match(estimates.select(*keys).distinct(), got, keys, "left").withColumn(
        out, F.coalesce(out, F.lit(FALLBACK_ESTIMATE)))


def concurrency_timeline(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Tasks running at the whole seconds of a run, from ``floor(duration) + 1`` samples: one row per change.

    ``count`` holds from ``second`` to ``until``, both included; the first row of a run is second 0, its last ends
    with the run. Rows grow with the tasks, not with how long a run is.
    """
    grid = runs.select("run_id", F.col("start_time").alias("_t0"),
                       F.floor(F.coalesce("duration_seconds", F.lit(0.0))).cast("long").alias("_last")).filter("_last >= 0")
    moves = F.array(F.struct(F.col("start_time").alias("t"), F.lit(1).alias("d")),
                    F.struct(F.col("end_time").alias("t"), F.lit(-1).alias("d")))
    at = F.greatest(F.ceil((F.unix_micros("t") - F.unix_micros("_t0")) / F.lit(1_000_000)), F.lit(0)).cast("long")
    changes = tasks.filter(F.col("start_time").isNotNull() & F.col("end_time").isNotNull()) \
        .select("run_id", F.inline(moves)).join(grid, "run_id").select("run_id", "_last", at.alias("second"), "d")
    per_second = changes.filter("second <= _last").unionByName(
        grid.select("run_id", "_last", F.lit(0).cast("long").alias("second"), F.lit(0).alias("d"))) \
        .groupBy("run_id", "_last", "second").agg(F.sum("d").alias("d")).filter("d <> 0 or second = 0")
    w = Window.partitionBy("run_id").orderBy("second")
    return per_second.select(
        "run_id", "second", (F.coalesce(F.lead("second").over(w), F.col("_last") + 1) - 1).alias("until"),
        F.greatest(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("count"))


def wait_sequences(lines: DataFrame, keys: Sequence[str], pos: str, is_wait: Column,
                   compact: bool = True, block: int = 100_000, also: dict[str, str] | None = None) -> DataFrame:
    """Task lines with the number of the sequence they belong to.

    ``wait`` lines split a file into sequences; each task waits for the whole sequence
    before its own. ``sequence`` counts wait marks, so it may skip empty sequences;
    ``previous`` is the sequence waited for (NULL for the first). With ``compact`` an
    empty sequence is passed over, without it a task behind one waits for nothing. ``also``
    names further running sums taken in the same pass.
    """
    keys = list(keys)
    marks = lines.withColumn("_w", is_wait.cast("long"))
    seq = cut(running_sums(marks, keys, pos, F.floor(F.col(pos) / block), {"sequence": "_w", **(also or {})}))
    work = seq.filter(F.col("_w") == 0).drop("_w")
    sizes = work.groupBy(*keys, "sequence").agg(F.count("*").alias("size"))
    place = numbered(sizes, keys, ["sequence"], "_no") if compact else sizes.withColumn("_no", F.col("sequence"))
    ahead = place.select(*keys, (F.col("_no") + 1).alias("_no"), F.col("sequence").alias("previous"),
                         F.col("size").alias("previous_size"))
    steps = match(place.drop("size"), ahead, [*keys, "_no"], "left").drop("_no")
    return match(work, steps, [*keys, "sequence"])


def renumber_results(results: DataFrame) -> DataFrame:
    """Gap-free task ids per run, by numeric original id and start; the original id is kept."""
    number = F.col("task_id").try_cast("double")
    order = [F.asc_nulls_last(number), F.asc_nulls_last("start_time"), task_order(results)]
    return numbered(results, ["run_id"], order, "_n") \
        .withColumnRenamed("task_id", "original_task_id") \
        .withColumn("task_id", F.col("_n").cast("string")).drop("_n")


def heavy_outliers(groups: DataFrame, keys: Sequence[str], sensitivity: float = 10.0,
                   value: str = "avg_duration") -> DataFrame:
    """Mark groups above ``q3 + k * iqr`` of their key; fewer than four groups have none."""
    keys = list(keys)
    q = order_statistics(histogram(groups, keys, value), keys, value, QUARTILES)
    iqr = F.col("q3") - F.col("q1")
    fences = q.filter(F.col("n") >= 4).select(
        *keys, "q1", "q3", iqr.alias("iqr"), (F.col("q3") + sensitivity * iqr).alias("upper_fence"))
    out = match(groups, fences, keys, "left")
    zero = [zero_if_null(F.col(c)).alias(c) for c in ("q1", "q3", "iqr", "upper_fence")]
    return out.select(*groups.columns, *zero,
                      F.coalesce(F.col(value) > F.col("upper_fence"), F.lit(False)).alias("is_heavy"))


def heavy_rank(groups: DataFrame, keys: Sequence[str], value: str = "avg_duration",
               tie: str = "driver_value") -> DataFrame:
    """Heavy groups numbered heaviest first: the order in which they are chained."""
    return numbered(groups.filter("is_heavy"), keys, [F.desc(value), F.col(tie)], "chain_rank")


def best_worst_level(levels: DataFrame) -> DataFrame:
    """Fastest and slowest worker level per workflow; fewer workers win a tie."""
    row = F.struct("max_workers", "wall_clock", "total_task_time", "effective_parallelism", "efficiency")
    fastest = F.struct(F.col("wall_clock"), F.col("max_workers"))
    slowest = F.struct(F.col("wall_clock"), -F.col("max_workers"))
    return levels.groupBy("workflow").agg(
        F.count("*").alias("levels"), F.min_by(row, fastest).alias("best"),
        F.max_by(row, slowest).alias("worst"))


# ---- rankings ---------------------------------------------------------------

def order_ready(tasks: DataFrame, keys: Sequence[str], estimate: str = "estimate", pos: str = "pos",
                longest_first: bool = True) -> DataFrame:
    """Dispatch order within ``keys`` by estimate; equal estimates keep their position."""
    by = F.desc(estimate) if longest_first else F.asc(estimate)
    return numbered(tasks, keys, [by, F.col(pos)], "dispatch_order")


def optimized_order(analysis: DataFrame) -> DataFrame:
    """Tasks of each workflow, longest estimate first."""
    return numbered(analysis, ["workflow"], [F.desc("ewma"), F.col("estimated"), F.col("task_signature")], "order")


def _top(tasks: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("duration_seconds"), task_order(tasks))
    return tasks.filter(F.col("duration_seconds").isNotNull()) \
        .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _median(tasks: DataFrame, keys: Sequence[str], upper: bool) -> DataFrame:
    hist = histogram(tasks.filter(success()), keys, "duration_seconds")
    mids = order_statistics(hist, keys, "duration_seconds", MIDDLES)
    mid = F.col("mid_high") if upper else (F.col("mid_low") + F.col("mid_high")) / 2
    return mids.select(*keys, mid.alias("median"))


def slowest(tasks: DataFrame, keys: Sequence[str] = ("workflow",), n: int = 20) -> DataFrame:
    """Slowest executions with their distance to the median success (0 if that is 0)."""
    top = match(_top(tasks, keys, n), _median(tasks, keys, upper=False), list(keys), "left")
    diff = rounded(F.col("duration_seconds") - F.col("median"), 2)
    return with_target(top).select(
        *keys, "rank", "task_id", "task_target", "task_kind", "instance", "run_id",
        rounded("duration_seconds", 2).alias("duration"), "status",
        F.when(F.coalesce("median", F.lit(0.0)) != 0, diff).otherwise(F.lit(0.0)).alias("vs_median"))


def slowest_recent(tasks: DataFrame, runs: DataFrame, last: int = 5, n: int = 10) -> DataFrame:
    """As ``slowest`` over the last runs, against the upper middle success."""
    recent = of_runs(tasks, newest_runs(runs, last))
    top = match(_top(recent, ["workflow"], n), _median(recent, ["workflow"], upper=True), ["workflow"], "left")
    diff = F.col("duration_seconds") - zero_if_null(F.col("median"))
    return with_target(top).select(
        "workflow", "rank", "task_id", "task_target", "task_kind", "instance", "run_id",
        rounded("duration_seconds", 2).alias("duration"), rounded(diff, 2).alias("vs_median"), "status")


TEXT_COLUMNS = ("task_id", "instance", "task_target")


def task_page(table: DataFrame, sort: str = "avg", ascending: bool | None = None,
              page: int = 0, size: int = 25) -> DataFrame:
    """One page of a task table; text sorts ascending and numbers descending by default."""
    up = sort in TEXT_COLUMNS if ascending is None else ascending
    key = F.col(sort)
    ordered = table.orderBy(key.asc() if up else key.desc(), "task_signature")
    return ordered if size == 0 else ordered.offset(page * size).limit(size)


def natural_order(tasks: DataFrame, keys: Sequence[str], by: str = "task_id", ties: Sequence[str] = ()) -> DataFrame:
    """Number tasks in natural order of ids (``task2`` before ``task10``), or by predecessor count.

    ``ties`` names the columns that order equal ids.
    """
    if by == "predecessors":
        first = F.coalesce(F.size("predecessors"), F.lit(0))
        return numbered(tasks, keys, [first, natural_key("task_id"), *ties], "position")
    return numbered(tasks, keys, [natural_key(by), *ties], "position")
