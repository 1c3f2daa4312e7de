"""Joins over runs, tasks and definitions, and the set operations between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from runtally.functions.scalars import fan_out_key, rate, rounded, success
from runtally.operators.history import zero_if_null
from runtally.operators.ordered import match, numbered, scanned
from runtally.schemas import INPUT_EXCLUSIONS, MEASURES, UNKNOWN_SET
from runtally.session import cut, kept

# ---- intervals --------------------------------------------------------------


def overlaps(rows: DataFrame, keys: Sequence[str], counts: dict[str, Column | None],
             start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Add how many other rows of the same key have an overlapping interval.

    Counted from running sums of starts and ends, never from pairs of rows: those that
    start before my end, less those that ended by my start. ``counts`` maps each new column
    to the flag of the rows it counts (None for all); a row never counts itself. Every row stays,
    whatever its id; the sums of a key are taken block by block, whatever its size.
    """
    keys = list(keys)
    flags = {c: F.lit(1) if f is None else F.coalesce(f, F.lit(False)).cast("int") for c, f in counts.items()}
    timed = F.col(start).isNotNull() & F.col(end).isNotNull()
    out = _overlaps_in_blocks(rows.filter(timed), keys, flags, start, end)
    alone = rows.filter(~timed).select("*", *[F.lit(0).cast("long").alias(c) for c in flags])
    return out.unionByName(alone).select(*rows.columns, *flags)


def _moves(flags: dict[str, Column], start: str, end: str) -> Column:
    """A start and an end per row: instant, flags that start, flags that end, flags of empty intervals."""
    def move(t: str, begins: bool) -> Column:
        fields = [F.col(t).alias("t"), F.lit(begins).alias("begins")]
        for i, n in enumerate(flags.values()):
            zero = F.lit(0)
            fields += [(n if begins else zero).alias(f"s{i}"), (zero if begins else n).alias(f"e{i}"),
                       (F.when(F.col(start) == F.col(end), n).otherwise(0) if begins else zero).alias(f"z{i}")]
        return F.struct(*fields)

    return F.array(move(start, True), move(end, False))


def _count(x: Column, y: Column, z: Column, own: Column, start: str, end: str) -> Column:
    """Others that overlap: started before my end ``x``, ended by my start ``y``, empty at my instant ``z``."""
    return F.when(F.col(start) == F.col(end), x - y + z).otherwise(x - y - own).cast("long")


def _overlaps_in_blocks(rows: DataFrame, keys: list[str], flags: dict[str, Column], start: str, end: str) -> DataFrame:
    """The sums are kept per distinct instant, however many there are in a stretch of time, and looked up by group and instant, so
    that rows that start together are split by the join and not sorted in one task."""
    ids = range(len(flags))
    points = rows.select(*keys, F.inline(_moves(flags, start, end))).groupBy(*keys, "t") \
        .agg(*[F.sum(f"{m}{i}").alias(f"{m}{i}") for i in ids for m in "sez"])
    sweep = scanned(points, keys, ["t"], sums={f"{m}u{i}": f"{m}{i}" for i in ids for m in "se"})
    place = F.struct(*[F.col(k) for k in keys])
    sweep = sweep.select(place.alias("_group"), "t", *[(F.col(f"su{i}") - F.col(f"s{i}")).alias(f"_x{i}") for i in ids],
                         *[F.col(f"eu{i}").alias(f"_y{i}") for i in ids], *[F.col(f"z{i}").alias(f"_z{i}") for i in ids])
    at_end = sweep.select("_group", F.col("t").alias(end), *[f"_x{i}" for i in ids])
    at_start = sweep.select("_group", F.col("t").alias(start), *[c for i in ids for c in (f"_y{i}", f"_z{i}")])
    both = rows.withColumn("_group", place).join(at_end, ["_group", end]).join(at_start, ["_group", start])
    return both.select(*rows.columns, *[
        _count(F.col(f"_x{i}"), F.col(f"_y{i}"), F.col(f"_z{i}"), own, start, end).alias(c)
        for i, (c, own) in enumerate(flags.items())])


def overlap_count(tasks: DataFrame) -> DataFrame:
    """Per successful task: how many tasks of its run, of any status, ran at the same time."""
    slim = tasks.select("run_id", "id", "task_id", "status", "start_time", "end_time", "duration_seconds")
    return overlaps(slim, ["run_id"], {"concurrent_count": None}).filter(success()).drop("status")


def blocking_sessions(sessions: DataFrame) -> DataFrame:
    """How many concurrent sessions on its instance block each session.

    An exclusive session is blocked by any other, a normal one only by exclusive ones.
    """
    both = overlaps(sessions, ["instance"], {"_any": None, "_excl": F.col("exclusive")})
    n = F.when(F.col("exclusive"), F.col("_any")).otherwise(F.col("_excl"))
    return both.withColumn("blocking", n).withColumn("must_wait", n > 0).drop("_any", "_excl")


# ---- runs and tasks ---------------------------------------------------------

def runs_with_tasks(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    header = runs.select("run_id", F.lower(F.coalesce("workflow", F.lit(""))).alias("workflow"),
                         F.col("start_time").alias("run_start"), "max_workers",
                         F.col("status").alias("run_status"))
    return header.join(tasks.drop("workflow"), "run_id", "left")


def run_details(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Run header; one that is missing is rebuilt from its tasks."""
    seen = tasks.groupBy("run_id").agg(
        F.min("workflow").alias("_wf"), F.min("start_time").alias("_start"), F.max("end_time").alias("_end"),
        F.count("*").alias("_n"), F.count_if(success()).alias("_ok"), F.count_if(~success()).alias("_bad"),
        F.sum("duration_seconds").alias("_total"))
    header = runs.select("run_id", "workflow", "start_time", "end_time", "duration_seconds", "task_count",
                         "success_count", "failure_count", F.lit(True).alias("_header"))
    there = F.coalesce("_header", F.lit(False))

    def pick(stored: str, observed: str, zero: bool = False):
        s = F.coalesce(F.col(stored), F.lit(0)) if zero else F.col(stored)
        return F.when(there, s).otherwise(F.col(observed))

    n, good = pick("task_count", "_n", True), pick("success_count", "_ok", True)
    d = F.when(F.col("duration_seconds") != 0, rounded("duration_seconds", 2))
    return header.join(seen, "run_id", "full").select(
        "run_id", pick("workflow", "_wf").alias("workflow"), pick("start_time", "_start").alias("start_time"),
        pick("end_time", "_end").alias("end_time"), d.alias("duration_seconds"), n.alias("task_count"),
        good.alias("success_count"), pick("failure_count", "_bad", True).alias("error_count"),
        rate(good, n).alias("success_rate"),
        zero_if_null(rounded("_total", 2)).alias("total_task_duration"), there.alias("has_header"))


def complete_run(runs: DataFrame, tasks: DataFrame, raised: DataFrame | None = None) -> DataFrame:
    """Close runs with what their tasks show; ``raised`` lists runs that ended in an error."""
    seen = tasks.groupBy("run_id").agg(
        F.min("start_time").alias("_s"), F.max("end_time").alias("_end"), F.count("*").alias("_n"),
        F.count_if(success()).alias("_ok"), F.count_if(~success()).alias("_bad"))
    both = runs.join(seen, "run_id", "left")
    status = F.lit("Success")
    if raised is not None:
        both = both.join(raised.select("run_id", F.lit(True).alias("_raised")), "run_id", "left")
        status = F.when(~F.coalesce("_raised", F.lit(False)), "Success") \
            .when(F.coalesce("_ok", F.lit(0)) > 0, "Partial").otherwise("Failed")
    end = F.coalesce("_end", "end_time")
    wall = (F.unix_micros(end) - F.unix_micros("start_time")) / F.lit(1_000_000.0)
    new = {"end_time": end, "duration_seconds": F.coalesce(rounded(wall, 3), "duration_seconds"),
           "status": F.coalesce(status, "status"),
           "task_count": F.coalesce(F.col("_n").cast("int"), "task_count"),
           "success_count": F.coalesce(F.col("_ok").cast("int"), "success_count"),
           "failure_count": F.coalesce(F.col("_bad").cast("int"), "failure_count")}
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in runs.columns])


def estimate_join(tasks: DataFrame, estimates: DataFrame, defaults: DataFrame,
                  min_samples: int = 3) -> DataFrame:
    """Attach an estimate; a signature unknown or seen too rarely takes its workflow's default."""
    est = estimates.select("task_signature", "ewma", "sample_count")
    known = F.coalesce(F.col("sample_count") >= min_samples, F.lit(False))
    return match(tasks.join(est, "task_signature", "left"), defaults, ["workflow"], "left") \
        .withColumn("estimate", F.when(known, F.col("ewma")).otherwise(F.col("default_estimate"))) \
        .drop("ewma", "sample_count", "default_estimate")


def latest_snapshot(runs: DataFrame) -> DataFrame:
    """Task document of each workflow's most recent successful run."""
    return runs.filter(success()).groupBy("workflow").agg(
        F.max_by(F.struct("run_id", "taskfile_path"), F.struct("start_time", "run_id")).alias("r")
    ).select("workflow", "r.*")


def checkpoint_match(checkpoints: DataFrame, taskfiles: DataFrame, strict: bool = True) -> DataFrame:
    """Checkpoints with the task file they were made for; a changed file is flagged.

    ``checkpoints(checkpoint, taskfile_path, taskfile_hash)``,
    ``taskfiles(taskfile_path, current_hash)``.
    """
    changed = ~F.col("taskfile_hash").eqNullSafe(F.col("current_hash"))
    text = F.concat(F.lit("ERROR" if strict else "WARNING"),
                    F.lit(": task file changed since checkpoint, was "),
                    F.substring("taskfile_hash", 1, 8), F.lit(" now "), F.substring("current_hash", 1, 8))
    return checkpoints.join(taskfiles, "taskfile_path").select(
        "checkpoint", "taskfile_path", changed.alias("changed"),
        (~changed | F.lit(not strict)).alias("valid"), F.when(changed, text).alias("message"))


# ---- definitions and graphs -------------------------------------------------

def chain_edges(task_params: DataFrame, heavy: DataFrame, fan_out: DataFrame) -> DataFrame:
    """Chain heavy groups across each fan-out value, heaviest first.

    ``task_params(workflow, pos, task_id, parameters)``; ``heavy(workflow, driver,
    driver_value, chain_rank)``; ``fan_out(workflow, fan_out_keys)``. The last task of a
    (driver value, fan-out value) stands for it; a missing one breaks the chain.
    """
    drivers = heavy.select("workflow", "driver").distinct()
    t = match(match(task_params, drivers, ["workflow"]), fan_out, ["workflow"]).select(
        "workflow", "pos", "task_id", F.coalesce(F.col("parameters")[F.col("driver")], F.lit("")).alias("driver_value"),
        fan_out_key("parameters", "fan_out_keys").alias("fan_out_value"))
    last = t.groupBy("workflow", "driver_value", "fan_out_value").agg(F.max_by("task_id", "pos").alias("task_id"))
    ranked = match(last, heavy.select("workflow", "driver_value", "chain_rank"), ["workflow", "driver_value"])
    ahead = ranked.select("workflow", "fan_out_value", (F.col("chain_rank") + 1).alias("chain_rank"),
                          F.col("task_id").alias("predecessor"))
    return match(ranked, ahead, ["workflow", "fan_out_value", "chain_rank"]) \
        .select("workflow", "fan_out_value", "chain_rank", "task_id", "predecessor")


def result_nodes(results: DataFrame) -> DataFrame:
    """Executed rows as graph nodes; rows that share a task id get ``.1``, ``.2``, …"""
    node = F.when(F.col("instances") > 1,
                  F.concat("task_id", F.lit("."), F.col("instance_no").cast("string"))).otherwise(F.col("task_id"))
    return scanned(results, ["run_id", "task_id"], ["id"], number="instance_no", size="instances").withColumn("node_id", node)


def fan_out_predecessors(results: DataFrame) -> DataFrame:
    """Dependencies between executed rows of a run.

    A predecessor that ran as many instances stands for all of them: the edge names the
    task id and ``predecessor_instances`` nodes ``id.1`` … ``id.n`` (or ``id`` when one),
    so a row is written per predecessor and not per pair of instances.
    """
    return node_predecessors(kept(result_nodes(results.select("run_id", "task_id", "id", "predecessors"))))


def node_predecessors(nodes: DataFrame) -> DataFrame:
    """``fan_out_predecessors`` of what ``result_nodes`` gives."""
    sizes = nodes.where("instance_no = 1").select("run_id", F.col("task_id").alias("predecessor"), F.col("instances").alias("predecessor_instances"))
    wants = nodes.select("run_id", "node_id", F.posexplode("predecessors").alias("pred_no", "predecessor"))
    many = F.col("predecessor_instances") > 1
    return match(wants, sizes, ["run_id", "predecessor"]).select(
        "run_id", "node_id", "pred_no", "predecessor", "predecessor_instances",
        F.when(many, F.concat("predecessor", F.lit(".1"))).otherwise(F.col("predecessor")).alias("first_node"),
        F.when(many, F.concat("predecessor", F.lit("."), F.col("predecessor_instances").cast("string")))
        .otherwise(F.col("predecessor")).alias("last_node"))


def dangling_predecessors(defs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Predecessors that name no task."""
    keys = list(keys)
    wants = defs.select(*keys, F.col("id").alias("task_id"), F.explode("predecessors").alias("predecessor"))
    have = defs.select(*keys, F.col("id").alias("predecessor"))
    return wants.distinct().join(have, [*keys, "predecessor"], "left_anti").select(*keys, "task_id", "predecessor")


def stage_edges(defs: DataFrame, keys: Sequence[str], stage_order: Sequence[str]) -> DataFrame:
    """Dependencies from stage order, through one gate node per pair of adjacent stages.

    Every task of a stage leads to the gate and the gate leads to every task of the next
    stage: the same reachability as all pairs, with one edge per task and side.
    """
    keys = list(keys)
    order = F.array(*[F.lit(s) for s in stage_order])
    t = cut(defs.filter(F.col("stage").isin(*stage_order))
            .select(*keys, "id", (F.array_position(order, F.col("stage")) - 1).cast("int").alias("stage_no")).distinct())
    sizes = t.groupBy(*keys, "stage_no").agg(F.count("*").alias("n"))
    gates = sizes.select(*keys, (F.col("stage_no") + 1).alias("stage_no"), F.col("n").alias("before"))
    gates = match(sizes.withColumnRenamed("n", "after"), gates, [*keys, "stage_no"])
    into = gates.select(*keys, F.col("stage_no").alias("gate_no"), (F.col("stage_no") - 1).alias("stage_no"))
    out = gates.select(*keys, F.col("stage_no").alias("gate_no"), "stage_no")
    gate = F.concat(F.lit("gate:"), F.col("gate_no").cast("string"))
    return match(t, into, [*keys, "stage_no"]).select(*keys, F.col("id").alias("pred"), gate.alias("succ")) \
        .unionByName(match(t, out, [*keys, "stage_no"]).select(*keys, gate.alias("pred"), F.col("id").alias("succ")))


#: Combinations that are listed at a time.
COMBINATIONS = 65_536


def expand_wildcards(defs: DataFrame, elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks whose ``name*`` parameters are replaced by every element of their set.

    ``elements(set_name, element_no, element)``. Several sets give all combinations, numbered in product order as ``id_1``, ``id_2``, …:
    every list of sets that tasks name is put together once, and each combination's elements are the digits of its number. A task
    carries the arrays of its sets, which are no longer than what it expands to. Expanded tasks leave out the chore, as
    chores have no parameters. A task that names a set which is not there stays as it is; ``unknown_sets`` lists what it names.
    """
    wild = F.filter(F.map_keys("parameters"), lambda k: k.endswith("*"))
    named = lambda k: F.coalesce(F.regexp_replace(F.col("parameters")[k], r"^\*", ""), F.lit(""))
    work = defs.withColumn("_wild", F.when(F.size(wild) > 0, wild)).withColumn("_sets", F.transform("_wild", named))
    combined = work.withColumnRenamed("_sets", "_list").join(_combined(work.select("_sets"), elements), F.col("_list").eqNullSafe(F.col("_sets")), "left")
    first = F.explode_outer(F.when(F.col("_total").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("_total") - 1, F.lit(COMBINATIONS))))
    here = F.explode_outer(F.when(F.col("_from").isNotNull(), F.sequence("_from", F.least(F.col("_from") + (COMBINATIONS - 1), F.col("_total") - 1))))
    # Definitions are narrow beside what they expand to: a split of them holds too many for one task.
    rows = combined.select("*", first.alias("_from")).hint("rebalance").select("*", here.alias("_no"))

    names = F.transform("_wild", lambda k: F.rtrim(k, F.lit("*")))
    found = F.transform("_arrays", lambda s, i: F.get(s["elements"], F.try_mod(
        F.floor(F.col("_no") / F.get("_strides", i)), F.size(s["elements"])).cast("int")))
    # Of wildcards that differ in their stars only, the last counts.
    pairs = F.filter(F.arrays_zip(names.alias("name"), found.alias("element"), F.sequence(F.lit(2), F.size("_wild") + 1).alias("next")),
                     lambda x: ~F.array_contains(F.slice(names, x["next"], F.size("_wild")), x["name"]))
    base = F.map_filter("parameters", lambda k, v: ~k.endswith("*") & ~F.array_contains(names, k))
    full = F.map_concat(base, F.map_from_arrays(F.transform(pairs, lambda x: x["name"]), F.transform(pairs, lambda x: x["element"])))
    new = {"parameters": F.when(F.col("_no").isNull(), F.col("parameters")).otherwise(full), "chore": F.when(F.col("_no").isNull(), F.col("chore"))}
    new_id = F.when(F.col("_total") > 1, F.concat("id", F.lit("_"), (F.col("_no") + 1).cast("string"))).otherwise(F.col("id"))
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in defs.columns], new_id.alias("expanded_id"))


def _combined(wanted: DataFrame, elements: DataFrame) -> DataFrame:
    """For every distinct list ``_sets`` of known sets: their ``_arrays``, the ``_strides`` of a combination's number and the ``_total``."""
    # A wildcard without a set's name stands for one null.
    none = elements.sparkSession.createDataFrame([("", 1, None)], "set_name string, element_no long, element string")
    rows = elements.select("set_name", F.col("element_no").cast("long").alias("element_no"), "element").unionByName(none)
    sets = rows.groupBy("set_name").agg(F.sort_array(F.collect_list(F.struct("element_no", "element"))).alias("_e")) \
        .select("set_name", F.transform("_e", lambda e: e["element"]).alias("elements"))
    lists = wanted.filter("_sets IS NOT NULL").distinct()
    named = lists.select("_sets", F.posexplode("_sets").alias("set_no", "set_name")).join(sets, "set_name")
    whole = named.groupBy("_sets").agg(F.sort_array(F.collect_list(F.struct("set_no", "elements"))).alias("_arrays")) \
        .filter(F.size("_arrays") == F.size("_sets"))
    sizes = F.transform("_arrays", lambda s: F.size(s["elements"]).cast("long"))
    product = lambda xs: F.aggregate(xs, F.lit(1).cast("long"), lambda x, y: x * y)
    strides = F.transform("_arrays", lambda s, i: product(F.slice(sizes, i + 2, F.size("_arrays"))))
    return whole.select("_sets", "_arrays", strides.alias("_strides"), product(sizes).alias("_total"))


def unknown_sets(defs: DataFrame, elements: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, id, parameter, set_name, message) of every wildcard parameter whose set has no elements."""
    wants = defs.select(*keys, "id", F.explode("parameters").alias("parameter", "value")).filter(F.col("parameter").endswith("*"))
    named = wants.withColumn("set_name", F.coalesce(F.regexp_replace("value", r"^\*", ""), F.lit(""))).filter("set_name <> ''")
    missing = named.join(elements.select("set_name").distinct(), "set_name", "left_anti")
    return missing.select(*keys, "id", "parameter", "set_name", F.concat(F.lit(UNKNOWN_SET), F.col("set_name")).alias("message"))


def remap_predecessors(defs: DataFrame, expanded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """After expansion, the ids each task waits for; unknown ids stay as they are.

    All expansions of a task wait for the same ids, so they are listed once per original
    task: (keys, id, pred_no, predecessor).
    """
    keys = list(keys)
    wants = defs.select(*keys, "id", F.posexplode("predecessors").alias("pred_no", "_was"))
    to = expanded.select(*keys, F.col("id").alias("_was"), F.col("expanded_id").alias("_now"))
    return match(wants, to, [*keys, "_was"], "left").select(
        *keys, "id", "pred_no", F.coalesce("_now", "_was").alias("predecessor"))


def apply_order(defs: DataFrame, order: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Tasks in a recommended order, the rest after them; and the ids the order has in vain.

    ``order(keys, id, rank)``. A repeated id counts where it comes first.
    """
    keys = list(keys)
    best = order.groupBy(*keys, "id").agg(F.min("rank").alias("_rank"))
    ordered = numbered(match(defs, best, [*keys, "id"], "left"), keys,
                       [F.asc_nulls_last("_rank"), F.col("pos")], "new_pos").drop("_rank")
    return ordered, best.join(defs.select(*keys, "id"), [*keys, "id"], "left_anti").select(*keys, "id")


def driver_major_order(defs: DataFrame, groups: DataFrame, chains: DataFrame, workers: DataFrame) -> DataFrame:
    """Tasks by heavy groups, then light ones, then uncovered, with chain predecessors put in.

    ``groups(workflow, driver, driver_value, avg_duration, is_heavy)``,
    ``chains(workflow, task_id, predecessor)``, ``workers(workflow, recommended_workers)``.
    """
    drivers = groups.select("workflow", "driver").distinct()
    value = F.coalesce(F.col("parameters")[F.col("driver")], F.lit(""))
    t = match(defs, drivers, ["workflow"], "left").withColumn("driver_value", value)
    t = match(t, groups.drop("driver"), ["workflow", "driver_value"], "left")
    link = chains.groupBy("workflow", F.col("task_id").alias("id")).agg(F.max("predecessor").alias("_p"))
    t = match(t, link, ["workflow", "id"], "left").withColumn(
        "predecessors", F.when(F.col("_p").isNotNull(), F.array("_p")).otherwise(F.col("predecessors")))
    place = F.when(F.col("is_heavy"), 0).when(F.col("avg_duration").isNotNull(), 1).otherwise(2)
    group_order = F.when(place < 2, F.col("driver_value"))
    out = numbered(t, ["workflow"], [place, F.desc_nulls_last("avg_duration"), group_order, F.col("pos")], "new_pos")
    return match(out.select(*defs.columns, "new_pos"), workers.select("workflow", "recommended_workers"),
                 ["workflow"], "left")


def upsert_members(dimension: DataFrame, incoming: DataFrame, key: str = "member") -> DataFrame:
    """Members of a dimension plus those seen for the first time."""
    fresh = incoming.select(key).distinct().join(dimension.select(key), key, "left_anti")
    return dimension.select(key).withColumn("added", F.lit(False)) \
        .unionByName(fresh.withColumn("added", F.lit(True)))


# ---- sets -------------------------------------------------------------------

def union_backends(*histories: DataFrame) -> DataFrame:
    """One history from several sources."""
    first, *rest = histories
    for h in rest:
        first = first.unionByName(h, allowMissingColumns=True)
    return first


def measure_frame(spark) -> DataFrame:
    return spark.createDataFrame([list(m) for m in MEASURES], "measure string, is_input boolean, is_result boolean")


def input_measures(cells: DataFrame, mode: str) -> DataFrame:
    """Measures present in ``cells`` that a task of this mode may set."""
    allowed = measure_frame(cells.sparkSession).filter("is_input").select("measure") \
        .filter(~F.col("measure").isin(*INPUT_EXCLUSIONS[mode]))
    return cells.select("measure").distinct().join(allowed, "measure", "left_semi")


def result_measures(cells: DataFrame) -> DataFrame:
    allowed = measure_frame(cells.sparkSession).filter("is_result").select("measure")
    return cells.select("measure").distinct().join(allowed, "measure", "left_semi")


def resume_set(state: DataFrame) -> DataFrame:
    """What an interrupted run does next: run again, or ask.

    ``state(checkpoint, task_id, state, safe_retry)``; finished and skipped tasks are left out.
    """
    retry = F.coalesce("safe_retry", F.lit(False))
    action = F.when(F.col("state") == "pending", "run").when(
        F.col("state") == "in_progress", F.when(retry, "run").otherwise("decide"))
    return state.withColumn("action", action).filter("action IS NOT NULL") \
        .groupBy("checkpoint", "task_id").agg(F.max("action").alias("action"))


def resume_from(defs: DataFrame, state: DataFrame, start: DataFrame) -> DataFrame:
    """Plan of a resume from a given task.

    ``defs(checkpoint, task_id, pos)``, ``state(checkpoint, task_id, state)``,
    ``start(checkpoint, resume_from)``. Completed tasks stay so, the others from the task
    on and all pending ones run, the rest is skipped; an unknown task gives an error row.
    """
    keys = ["checkpoint"]
    at = match(start, defs.groupBy(*keys, F.col("task_id").alias("resume_from")).agg(F.min("pos").alias("_at")),
               [*keys, "resume_from"], "left")
    seen = state.groupBy(*keys, "task_id").agg(
        F.bool_or(F.col("state") == "completed").alias("_done"), F.bool_or(F.col("state") == "pending").alias("_wait"))
    t = match(match(defs, at.filter("_at IS NOT NULL"), keys), seen, [*keys, "task_id"], "left")
    action = (F.when(F.coalesce("_done", F.lit(False)), "completed")
              .when((F.col("pos") >= F.col("_at")) | F.coalesce("_wait", F.lit(False)), "run").otherwise("skipped"))
    bad = at.filter("_at IS NULL").select("checkpoint", F.col("resume_from").alias("task_id"), F.lit("error").alias("action"))
    return t.select("checkpoint", "task_id", action.alias("action")).unionByName(bad)


def with_defaults(estimates: DataFrame, signatures: DataFrame, defaults: DataFrame) -> DataFrame:
    """Estimates plus the default for signatures of the workflow without any success."""
    missing = match(signatures.join(estimates.select("workflow", "task_signature"),
                                    ["workflow", "task_signature"], "left_anti"), defaults, ["workflow"], "left")
    return estimates.select("workflow", "task_signature", "ewma", F.lit(False).alias("estimated")).unionByName(
        missing.select("workflow", "task_signature", F.col("default_estimate").alias("ewma"),
                       F.lit(True).alias("estimated")))


def instances(defs: DataFrame) -> DataFrame:
    return defs.select("workflow", "instance").distinct()


