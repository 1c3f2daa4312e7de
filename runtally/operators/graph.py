"""Graph operators over many small dependency graphs at once.

A graph is two frames, nodes ``(keys, node)`` and edges ``(keys, pred, succ)``. Nodes may have a ``weight``: 1 for tasks (the
default), 0 for the gates through which stages, wait marks and fan-outs lead, so that a path is as long as its tasks are many.

Graphs of at most ``SMALL`` rows are worked out in the arrays of a batch of graphs (``small_graphs``). In larger ones loops contract paths: a
node with one open predecessor points past it, and pointers are followed to where they lead, so the rounds of a chain grow with the
logarithm of its length. The state of a round is one frame of edges, as many as there were or fewer; it is kept as a table, so neither lineage nor plan
grows and a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from runtally.operators import small_graphs as few
from runtally.operators.joins import node_predecessors, result_nodes, stage_edges
from runtally.operators.ordered import match
from runtally.session import cut, kept

FINISHED = ("completed", "failed", "skipped")

#: Lengths are held at this value: no path without a cycle is longer.
ENDLESS = 1 << 40

#: Rows of nodes and edges up to which a graph lies in one task; its rounds then need no join.
SMALL = 512


def edges(defs: DataFrame, keys: Sequence[str], node: str = "id") -> DataFrame:
    """Distinct dependencies from predecessor arrays."""
    return defs.select(*keys, F.explode("predecessors").alias("pred"), F.col(node).alias("succ")).distinct()


def nodes_of(defs: DataFrame, keys: Sequence[str], node: str = "id") -> DataFrame:
    return defs.select(*keys, F.col(node).alias("node")).distinct()


# ---- graphs with gates ---------------------------------------------------------

def _gated(tasks: DataFrame, gate_edges: DataFrame, gates: Column, keys: list[str], *more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with weights and edges of tasks and of the gates that ``gates`` names in ``gate_edges(keys, pred, succ, gate)``; an edge may come twice."""
    names = gate_edges.select(*keys, gates.alias("node")).distinct()
    nodes = tasks.select(*keys, "node", F.lit(1).alias("weight")).unionByName(names.withColumn("weight", F.lit(0)))
    edge = gate_edges.select(*keys, "pred", "succ")
    for e in more:
        edge = edge.unionByName(e.select(*keys, "pred", "succ"))
    return nodes, edge


def stage_graph(defs: DataFrame, keys: Sequence[str], stage_order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Tasks with their predecessors, and a gate between each stage and the next: nodes ``(keys, node, weight)``, edges."""
    keys = list(keys)
    through = stage_edges(defs, keys, stage_order)
    inward = F.col("succ").startswith("gate:")
    return _gated(nodes_of(defs, keys), through, F.when(inward, F.col("succ")).otherwise(F.col("pred")), keys, edges(defs, keys))


def wait_graph(sequences: DataFrame, keys: Sequence[str], node: str = "id") -> tuple[DataFrame, DataFrame]:
    """Tasks of ``wait_sequences`` and a gate before each sequence that waits for another, with an edge for each task and side."""
    keys = list(keys)
    tasks = kept(sequences.select(*keys, F.col(node).alias("node"), "sequence", "previous"))
    waits = tasks.where("previous IS NOT NULL").select(*keys, F.concat(F.lit("wait:"), F.col("sequence").cast("string")).alias("gate"), "sequence", "previous", "node")
    ahead = waits.select(*keys, "gate", F.col("previous").alias("sequence")).distinct()
    into = match(tasks.select(*keys, "node", "sequence"), ahead, [*keys, "sequence"]).select(*keys, F.col("node").alias("pred"), F.col("gate").alias("succ"), "gate")
    out = waits.select(*keys, F.col("gate").alias("pred"), F.col("node").alias("succ"), "gate")
    return _gated(tasks.select(*keys, "node").distinct(), into.unionByName(out), F.col("gate"), keys)


def fan_out_graph(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Executed rows of a run; a predecessor with several instances is a gate ``all:id`` behind all of them."""
    placed = kept(result_nodes(results.select("run_id", "task_id", "id", F.array_distinct("predecessors").alias("predecessors"))))
    gate, several = F.concat(F.lit("all:"), F.col("task_id")), placed.where("instances > 1")
    gates = several.where("instance_no = 1").select("run_id", gate.alias("node"), F.lit(0).alias("weight"))
    nodes = placed.select("run_id", F.col("node_id").alias("node"), F.lit(1).alias("weight")).unionByName(gates)
    into = several.select("run_id", F.col("node_id").alias("pred"), gate.alias("succ"))
    many = F.col("predecessor_instances") > 1
    direct = node_predecessors(placed).select(
        "run_id", F.when(many, F.concat(F.lit("all:"), F.col("predecessor"))).otherwise(F.col("predecessor")).alias("pred"), F.col("node_id").alias("succ"))
    return nodes, into.unionByName(direct)


# ---- paths ----------------------------------------------------------------------

def _id(keys: Sequence[str], node: str) -> Column:
    """Graph and node as one value; two of them are equal where nulls in the keys are."""
    return F.struct(*[F.col(k).alias(k) for k in keys], F.col(node).alias("node"))


def _weight(nodes: DataFrame) -> Column:
    return F.col("weight").cast("long") if "weight" in nodes.columns else F.lit(1).cast("long")


def _parts(nodes: DataFrame, edge: DataFrame, keys: Sequence[str], start: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the graphs of at most ``SMALL`` rows, and of the others (None without any), which have a number ``k`` for each graph.

    A row (g, node, pred, weight, kind) is a node with its weight, an edge ``node`` behind ``pred``, or a node of ``start``.
    """
    g = F.struct(*([F.col(k).alias(k) for k in keys] or [F.lit(0).alias("_")])).alias("g")
    none, no_weight = F.lit(None).cast(edge.schema["pred"].dataType).alias("pred"), F.lit(None).cast("long").alias("weight")
    kind = lambda x: F.lit(x).cast("byte").alias("kind")
    rows = nodes.select(g, "node", none, _weight(nodes).alias("weight"), kind(few.NODE))
    rows = rows.unionByName(edge.select(g, F.col("succ").alias("node"), "pred", no_weight, kind(few.EDGE)))
    if start is not None:
        rows = rows.unionByName(start.select(g, "node", none, no_weight, kind(few.START)))
    rows = kept(rows)
    big = kept(rows.groupBy("g").count().where(F.col("count") > SMALL).select("g", F.monotonically_increasing_id().alias("k")))
    if big.isEmpty():
        return rows, None
    return rows.join(big, "g", "left_anti"), rows.join(big, "g")


def _keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(f"g.{k}").alias(k) for k in keys]


# ---- large graphs: rounds of joins ----------------------------------------------------

def _numbered(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names (g, k, node, weight, v) of the nodes, and edges (k, v, p) between them: ``v`` and ``p`` are numbers of nodes, ``k`` of a graph."""
    names = large.where(F.col("kind") != few.EDGE).groupBy("g", "k", "node").agg(F.max("weight").alias("weight"), F.max(F.col("kind") == few.START).alias("start"))
    names = kept(names.withColumn("v", F.monotonically_increasing_id()))
    e = large.where(F.col("kind") == few.EDGE).select("k", F.col("node").alias("_s"), F.col("pred").alias("_p"))
    for end, out in (("_s", "v"), ("_p", "p")):
        e = match(e, names.select("k", F.col("node").alias(end), F.col("v").alias(out)), ["k", end]).drop(end)
    return names, kept(e.select("k", "v", "p").distinct())


def _longest(names: DataFrame, e: DataFrame) -> DataFrame:
    """(g, node, weight, level) of every node of large graphs; the level of nodes on or behind a cycle is null.

    A row (v, p, dist) says that the node is ``dist`` behind p, or, where p is null, behind a start; a start no farther than a predecessor
    does not matter. Each round rows that lead to a node with one row left go on to where that leads, and nodes that have come down to a
    start leave. Nodes to which no row leads any more are in nobody's way: once they hold half of the rows they wait until the others are
    known. When no node has come down, the rest hang on cycles.
    """
    def flagged(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("v").agg(
            F.count("p").alias("others"), F.max(F.when(F.col("p").isNotNull(), F.col("dist"))).alias("top"),
            F.max(F.when(F.col("p").isNull(), F.col("dist"))).alias("base"))
        behind = F.coalesce(F.col("base") <= F.col("top"), F.lit(False))
        alone = (F.col("others") == 1) & (behind | F.col("base").isNull())
        return kept(rows.join(_wanted(sums, rows), "v").where(F.col("p").isNotNull() | ~behind).select("v", "p", "dist", alone.alias("alone"), (F.col("others") == 0).alias("settled"), "wanted"))

    inner = e.join(names.select(F.col("v").alias("p"), F.col("weight").alias("dist")), "p")
    state = flagged(names.select("v").join(inner, "v", "left").select("v", "p", F.coalesce("dist", F.lit(0).cast("long")).alias("dist")))
    done, parked = [], []
    while True:
        n, settled, idle = _counted(state)
        done.append(state.where("settled").select("v", "dist"))
        if settled in (0, n):
            break
        if 2 * idle >= n - settled:
            parked.append(state.where(IDLE).select("v", "p", "dist"))
            state = state.where(f"NOT ({IDLE})")
        state = flagged(_followed(state, "left").groupBy("v", "p").agg(F.max("dist").alias("dist")))
    known = _settled(done, parked, lambda x: F.when(F.count(x) == F.count(F.lit(1)), F.max(x)))
    return names.join(known.withColumnRenamed("dist", "level"), "v", "left").select("g", "node", "weight", "level")


#: Rows of nodes that are still open and to which no row leads.
IDLE = "NOT settled AND NOT wanted"


def _wanted(sums: DataFrame, rows: DataFrame) -> DataFrame:
    """Whether some row leads to the node."""
    ends = rows.where("p IS NOT NULL").select(F.col("p").alias("v")).distinct().withColumn("_end", F.lit(True))
    return sums.join(ends, "v", "left").withColumn("wanted", F.coalesce("_end", F.lit(False))).drop("_end")


def _settled(done: list[DataFrame], parked: list[DataFrame], of) -> DataFrame:
    """(v, dist) of the nodes that came down to a start, then of those that waited, last ones first, from all ways ``of`` their rows."""
    known = done[0]
    for part in done[1:]:
        known = known.unionByName(part)
    for part in reversed(parked):
        ends = known.select(F.col("v").alias("p"), F.col("dist").alias("_end"))
        way = F.when(F.col("p").isNull(), F.col("dist")).otherwise(F.col("dist") + F.col("_end"))
        known = kept(known.unionByName(part.join(ends, "p", "left").groupBy("v").agg(of(way).alias("dist")).where("dist IS NOT NULL")))
    return known


def _counted(state: DataFrame) -> tuple[int, int, int]:
    """Rows of a round, how many of them have settled and how many of the others are idle."""
    return tuple(state.agg(F.count(F.lit(1)), F.count_if("settled"), F.count_if(F.expr(IDLE))).first())


def _followed(state: DataFrame, how: str) -> DataFrame:
    """(v, p, dist), and ``k`` if there, of the nodes that have not settled, led past predecessors that have settled or have one row left.

    No row leads to a settled node afterwards. With ``inner``, rows that lead to no node of the round go.
    """
    own = [c for c in ("k", "v") if c in state.columns]
    ends, rows = state.where("settled").select("v", "dist"), state.where("not settled")
    lone = rows.where("alone").select(F.col("v").alias("_p"), "p", "dist").join(ends.select(F.col("v").alias("p"), F.col("dist").alias("_end")), "p", "left")
    known = lone.select("_p", F.when(F.col("_end").isNull(), F.col("p")).alias("_q"), (F.col("dist") + F.coalesce("_end", F.lit(0))).alias("_more"), F.lit(True).alias("_over"))
    none = F.lit(None).cast("long")
    known = known.unionByName(ends.select(F.col("v").alias("_p"), none.alias("_q"), F.col("dist").alias("_more"), F.lit(True).alias("_over")))
    if how == "inner":
        known = known.unionByName(rows.where("not alone").select(F.col("v").alias("_p"), none.alias("_q"), F.lit(0).cast("long").alias("_more"), F.lit(False).alias("_over")).distinct())
    led = rows.where("p IS NOT NULL").join(known, F.col("p") == F.col("_p"), how).select(
        *own, F.when(F.col("_over"), F.col("_q")).otherwise(F.col("p")).alias("p"), F.least(F.col("dist") + F.coalesce("_more", F.lit(0)), F.lit(ENDLESS)).alias("dist"))
    return rows.where("p IS NULL").select(*own, "p", "dist").unionByName(led)


def _levels(nodes: DataFrame, edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(g, node, weight, level) of every node; the level of held ones is null."""
    small, large = _parts(nodes, edge, keys)
    found = few.levels(small)
    return found if large is None else found.unionByName(_longest(*_numbered(large)))


def levels(nodes: DataFrame, edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest-path depth, in tasks, of every task that is not held by a cycle; gates have none. Predecessors that are no node count nothing."""
    return _levels(nodes, edge, keys).where("weight > 0 AND level IS NOT NULL").select(*_keys(keys), "node", F.col("level").cast("int").alias("level"))


def held(nodes: DataFrame, edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The nodes on or behind a cycle, gates included, and whether a cycle is still ahead of them (``ahead``).

    Held nodes are those that never come down to a start; those from which a cycle can be reached never do on the turned edges either.
    """
    small, large = _parts(nodes, edge, keys)
    found = few.held(small).select(*_keys(keys), "node", "ahead")
    if large is None:
        return found
    names, e = _numbered(large)
    return found.unionByName(_large_held(names, e)[0].select(*_keys(keys), "node", "ahead"))


def _large_held(names: DataFrame, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, node, v, ahead) of the held nodes of large graphs, and the edges between them."""
    known = _longest(names, e)
    stuck = kept(known.where("level IS NULL").select(F.struct("g", "node").alias("_i")).join(names.select(F.struct("g", "node").alias("_i"), "v"), "_i").select("_i.*", "v"))
    some = e
    for end in ("v", "p"):
        some = some.join(stuck.select(F.col("v").alias(end)), end, "left_semi")
    some = kept(some.select("v", "p"))
    turned = _longest(stuck.select("g", "node", F.lit(1).cast("long").alias("weight"), "v"), some.select(F.col("p").alias("v"), F.col("v").alias("p")))
    core = turned.where("level IS NULL").select(F.struct("g", "node").alias("_i")).withColumn("ahead", F.lit(True))
    both = stuck.withColumn("_i", F.struct("g", "node")).join(core, "_i", "left")
    return kept(both.select("g", "node", "v", F.coalesce("ahead", F.lit(False)).alias("ahead"))), some


def cycles(nodes: DataFrame, edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One cycle of every graph that has some: (keys, step, node), each node a predecessor of the next, the last one of the first.

    Every node with a cycle on both sides follows its least such predecessor. Pointers are doubled until they have passed all nodes: what
    they then point at lies on a cycle. The one that holds the least node of its graph's cycles is given, from that node on; gates are nodes.
    """
    small, large = _parts(nodes, edge, keys)
    found = few.cycles(small).select(*_keys(keys), "step", "node")
    return found if large is None else found.unionByName(_large_cycles(*_numbered(large)).select(*_keys(keys), "step", "node"))


def _large_cycles(names: DataFrame, e: DataFrame) -> DataFrame:
    held_nodes, some = _large_held(names, e)
    core = held_nodes.where("ahead")
    of = core.select("v", F.struct("g", "node").alias("i"))
    between = some.join(of.withColumnRenamed("i", "s"), "v").join(of.select(F.col("v").alias("p"), F.col("i").alias("t")), "p")
    step = kept(between.groupBy(F.col("s").alias("v")).agg(F.min("t.node").alias("node")).select("v", F.col("v").withField("node", F.col("node")).alias("to")))
    most = step.groupBy("v.g").count().agg(F.max("count")).first()[0] or 0
    # least: the smallest node among those passed
    far = step.select("v", "to", F.col("to").alias("least"))
    for _ in range(int(most).bit_length()):
        ahead = far.select(F.col("v").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        far = kept(far.join(ahead, "to").select("v", F.col("_to").alias("to"), F.least("least", "_least").alias("least")))
    on = far.select(F.col("to").alias("v")).distinct()
    ring = far.join(on, "v", "left_semi").select("v", "least")
    first = ring.groupBy(F.col("v.g").alias("_g")).agg(F.min("least").alias("least")).select("least")
    chosen = kept(ring.join(first, "least", "left_semi").join(step, "v"))
    # Backwards along the predecessors to the least node: the steps to it are the place behind it.
    walk = chosen.select("v", F.when(F.col("v") != F.col("least"), F.col("to")).alias("to"), F.when(F.col("v") != F.col("least"), 1).otherwise(0).cast("long").alias("step"))
    for _ in range(int(most).bit_length()):
        ahead = walk.select(F.col("v").alias("to"), F.col("to").alias("_to"), F.col("step").alias("_step"))
        walk = kept(walk.join(ahead, "to", "left").select("v", F.col("_to").alias("to"), (F.col("step") + F.coalesce("_step", F.lit(0))).alias("step")))
    return walk.select("v.g", "step", "v.node")


def acyclic(nodes: DataFrame, edge: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per graph whether it is free of cycles, and how many nodes a cycle holds."""
    small, large = _parts(nodes, edge, keys)
    found = few.counts(small)
    if large is not None:
        found = found.unionByName(_longest(*_numbered(large)).groupBy("g").agg(F.count("*").alias("nodes"), F.count_if(F.col("level").isNull()).alias("held")))
    return found.select(*_keys(keys), "nodes", "held", (F.col("held") == 0).alias("is_acyclic"))


def task_status(instances: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status per task id over its instances ``(keys, task_id, instance_no, state, success)``.

    Done when all instances are; failed when one of them failed.
    """
    done = F.col("state").isin(*FINISHED)
    skipped = F.bool_and(F.col("state") == "skipped")
    status = (F.when(skipped, "skipped")
              .when(F.bool_and(done), F.when(F.bool_and(F.coalesce("success", F.lit(False))), "completed")
                    .otherwise("failed"))
              .when(F.bool_or(F.col("state") != "pending"), "running").otherwise("pending"))
    return instances.groupBy(*keys, "task_id").agg(status.alias("status"))


def ready_tasks(instances: DataFrame, edge: DataFrame, keys: Sequence[str], gates: DataFrame | None = None) -> DataFrame:
    """Instances that may start: all predecessors finished, or the task is already running.

    A predecessor that names no task never finishes. A gate ``gates(keys, node)`` is finished when all its predecessors are.
    """
    keys, instances = list(keys), kept(instances)
    status = task_status(instances, keys)
    done = status.filter(F.col("status").isin(*FINISHED)).select(*keys, F.col("task_id").alias("pred"))
    if gates is not None:
        done = done.unionByName(_passed(done, edge, keys, gates))
    e = edge.select("*", _id(keys, "pred").alias("_p"))
    waiting = e.join(done.select(_id(keys, "pred").alias("_p")).distinct(), "_p", "left_anti").select(_id(keys, "succ").alias("_v")).distinct()
    state = status.select(_id(keys, "task_id").alias("_v"), "status")
    free = state.join(waiting.withColumn("_wait", F.lit(True)), "_v", "left")
    may = free.where((F.col("status") == "running") | ((F.col("status") == "pending") & F.col("_wait").isNull())).select("_v")
    return instances.filter(F.col("state") == "pending").withColumn("_v", _id(keys, "task_id")).join(may, "_v", "left_semi") \
        .select(*keys, "task_id", "instance_no")


def _passed(done: DataFrame, edge: DataFrame, keys: list[str], gates: DataFrame) -> DataFrame:
    """(keys, pred) of the gates behind which nothing is open: neither an unfinished task nor, through other gates, one further off."""
    all_gates = gates.select(_id(keys, "node").alias("v")).distinct()
    into = edge.select(_id(keys, "pred").alias("p"), _id(keys, "succ").alias("v")).join(all_gates, "v", "left_semi")
    of_gates = cut(into.join(all_gates.select(F.col("v").alias("p")), "p", "left_semi"))
    tasks = into.join(all_gates.select(F.col("v").alias("p")), "p", "left_anti")
    shut = tasks.join(done.select(_id(keys, "pred").alias("p")), "p", "left_anti").select("v").distinct()
    if not of_gates.isEmpty():
        names = all_gates.select("v.*")
        reached = skip_closure(shut.select("v.*"), of_gates.select(*[F.col(f"v.{k}").alias(k) for k in keys], F.col("p.node").alias("pred"), F.col("v.node").alias("succ")), names, keys)
        shut = shut.union(reached.select(_id(keys, "node")))
    return all_gates.join(shut, "v", "left_anti").select(*[F.col(f"v.{k}").alias(k) for k in keys], F.col("v.node").alias("pred"))


def predecessor_check(defs: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First predecessor, in listed order, that keeps a task from running.

    ``results(keys, task_id, success)`` has one row per finished task id. Only tasks that
    require predecessor success are checked.
    """
    keys = list(keys)
    wants = defs.filter("require_predecessor_success").select(
        *keys, F.col("id").alias("_id"), F.posexplode("predecessors").alias("pred_no", "task_id"))
    got = results.select(*keys, "task_id", F.col("success").alias("_ok"))
    bad = match(wants, got, [*keys, "task_id"], "left").filter(~F.coalesce("_ok", F.lit(False)))
    why = F.when(F.col("_ok").isNull(), "uncompleted").otherwise("failed")
    return bad.groupBy(*keys, F.col("_id").alias("id")).agg(
        F.min_by(F.struct("task_id", why.alias("reason")), "pred_no").alias("o")).select(
        *keys, "id", F.col("o.task_id").alias("predecessor"), "o.reason")


def skip_closure(failed: DataFrame, edge: DataFrame, strict: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks that cannot succeed after ``failed(keys, node)``, through tasks that require it.

    ``strict(keys, node)`` lists the tasks that require predecessor success, and gates with ``weight`` 0, which hand on what
    fails before them. Returns the tasks reached with the round they were reached in, counted in tasks.
    """
    small, large = _parts(strict, edge, keys, failed)
    found = few.closure(small)
    if large is not None:
        found = found.unionByName(_nearest(*_numbered(large)))
    return found.where("dist > 0 AND weight > 0").select(*_keys(keys), "node", F.col("dist").cast("int").alias("round"))


def _nearest(names: DataFrame, e: DataFrame) -> DataFrame:
    """(g, node, weight, dist) of the nodes of large graphs that a start reaches.

    As in ``levels``, a node with one row left is passed over, and nodes to which no row leads wait. A predecessor no nearer than the
    node's own start does not matter, and the least distance of a graph is final, so nodes on a cycle come down to a start as well; what
    no failure reaches is left out.
    """
    start = names.where("start").select("k", "v", F.lit(None).cast("long").alias("p"), F.lit(0).cast("long").alias("dist"))
    into = e.join(names.where("NOT start").select("v", F.col("weight").alias("dist")), "v").select("k", "v", "p", "dist")

    def flagged(rows: DataFrame) -> DataFrame:
        rows = rows.where("p IS NULL OR p <> v")
        sums = rows.groupBy("v", F.col("k").alias("_k")).agg(F.count("p").alias("others"), F.min(F.when(F.col("p").isNull(), F.col("dist"))).alias("base"),
                                                             F.min(F.when(F.col("p").isNotNull(), F.col("dist"))).alias("near"))
        least = sums.where("near < base").groupBy("_k").agg(F.min("base").alias("least"))
        final = F.coalesce((F.col("others") == 0) | (F.col("near") >= F.col("base")) | (F.col("base") <= F.col("least")), F.lit(False))
        sums = _wanted(sums.join(least, "_k", "left").select("v", "others", "base", final.alias("settled")), rows)
        return kept(rows.join(sums, "v").where(F.col("p").isNull() | (~F.col("settled") & (F.col("dist") < F.coalesce("base", F.lit(ENDLESS))))).select(
            "k", "v", "p", "dist", ((F.col("others") == 1) & F.col("base").isNull()).alias("alone"), "settled", "wanted"))

    state = flagged(start.unionByName(into))
    done, parked, quiet = [], [], 0
    while True:
        rows, settled, idle = _counted(state)
        done.append(state.where("settled").select("v", "dist"))
        quiet = 0 if settled else quiet + 1
        if settled == rows or quiet == 2:
            break
        if 2 * idle >= rows - settled:
            parked.append(state.where(IDLE).select("v", "p", "dist"))
            state = state.where(f"NOT ({IDLE})")
        state = flagged(_followed(state, "inner").groupBy("k", "v", "p").agg(F.min("dist").alias("dist")))
    return names.join(_settled(done, parked, F.min), "v").select("g", "node", "weight", "dist")
