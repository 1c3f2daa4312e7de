"""Graph operators over one small graph per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import dag_defs, definitions, results
from runtally.operators import graph as g, windows as w
from runtally.operators.ordered import numbered

K = ["run_id"]

# A graph has at most seven nodes, so a path of seven edges must run round a cycle.
WALK = """WITH RECURSIVE inner_edge AS (SELECT * FROM dagedge e WHERE EXISTS (SELECT 1 FROM dag d WHERE d.run_id = e.run_id AND d.id = e.pred)),
 walk(run_id, node, depth) AS (SELECT run_id, id, 0 FROM dag UNION SELECT w.run_id, e.succ, w.depth + 1 FROM walk w JOIN inner_edge e ON e.run_id = w.run_id AND e.pred = w.node WHERE w.depth < 8),
 lv AS (SELECT run_id, node, max(depth) AS level FROM walk GROUP BY run_id, node)"""


def _graph(spark, sf):
    d = dag_defs(spark, sf)
    return g.nodes_of(d, K), g.edges(d, K)


@query("edges", "SELECT run_id, pred, succ FROM dagedge")
def edges(spark, sf):
    return _graph(spark, sf)[1]


@query("levels", f"{WALK} SELECT run_id, node, level FROM lv WHERE level < 7")
def levels(spark, sf):
    return g.levels(*_graph(spark, sf), K)


@query("acyclic", f"{WALK} SELECT run_id, count(*) AS nodes, count(*) FILTER (level >= 7) AS held, count(*) FILTER (level >= 7) = 0 AS is_acyclic FROM lv GROUP BY run_id")
def acyclic(spark, sf):
    return g.acyclic(*_graph(spark, sf), K)


def _instances(spark, sf):
    r = numbered(results(spark, sf).select(F.col("run_id").cast("long").alias("run_id"), "task_id", "id", "status", "retry_count"),
                 ["run_id", "task_id"], ["id"], "instance_no")
    good = F.col("status") == "Success"
    state = F.when(good & (F.col("retry_count") == 0), "completed").when(~good, "failed").when(F.col("retry_count") == 1, "pending").otherwise("running")
    return r.select("run_id", "task_id", "instance_no", state.alias("state"), F.when(state == "completed", True).when(state == "failed", False).alias("success"))


INST = """inst AS (SELECT CAST(run_id AS BIGINT) AS run_id, task_id, row_number() OVER (PARTITION BY run_id, task_id ORDER BY id) AS instance_no,
   CASE WHEN status = 'Success' AND retry_count = 0 THEN 'completed' WHEN status <> 'Success' THEN 'failed' WHEN retry_count = 1 THEN 'pending' ELSE 'running' END AS state FROM res),
 st AS (SELECT run_id, task_id, CASE WHEN bool_and(state IN ('completed', 'failed')) THEN 'finished' WHEN bool_or(state <> 'pending') THEN 'running' ELSE 'pending' END AS status FROM inst GROUP BY run_id, task_id)"""


@query("ready_tasks", f"""WITH {INST}, blocked AS (SELECT DISTINCT e.run_id, e.succ AS task_id FROM dagedge e LEFT JOIN st ON st.run_id = e.run_id AND st.task_id = e.pred WHERE coalesce(st.status, '') <> 'finished')
 SELECT i.run_id, i.task_id, i.instance_no FROM inst i JOIN st USING (run_id, task_id) LEFT JOIN blocked b ON b.run_id = i.run_id AND b.task_id = i.task_id
 WHERE i.state = 'pending' AND (st.status = 'running' OR (st.status = 'pending' AND b.task_id IS NULL))""")
def ready_tasks(spark, sf):
    return g.ready_tasks(_instances(spark, sf), _graph(spark, sf)[1], K)


@query("predecessor_check", """WITH w AS (SELECT run_id, id, unnest(preds) AS p, unnest(range(len(preds))) AS n FROM dag WHERE require_predecessor_success),
 b AS (SELECT w.*, d.bad, d.open FROM w LEFT JOIN dag d ON d.run_id = w.run_id AND d.id = w.p AND d.open < 3)
 SELECT run_id, id, min_by(p, n) AS predecessor, min_by(CASE WHEN bad IS NULL THEN 'uncompleted' ELSE 'failed' END, n) AS reason FROM b WHERE bad IS NULL OR bad > 0 GROUP BY run_id, id""")
def predecessor_check(spark, sf):
    d = dag_defs(spark, sf)
    done = d.filter("open < 3").select("run_id", F.col("id").alias("task_id"), (F.col("bad") == 0).alias("success"))
    return g.predecessor_check(d, done, K)


@query("skip_closure", """WITH RECURSIVE hard AS (SELECT e.* FROM dagedge e JOIN dag d ON d.run_id = e.run_id AND d.id = e.succ WHERE d.require_predecessor_success OR CAST(d.id AS INTEGER) > 2),
 hit(run_id, node, round) AS (SELECT run_id, id, 0 FROM dag WHERE bad > 0 UNION SELECT h.run_id, e.succ, h.round + 1 FROM hit h JOIN hard e ON e.run_id = h.run_id AND e.pred = h.node WHERE h.round < 9)
 SELECT run_id, node, min(round) AS round FROM hit GROUP BY run_id, node HAVING min(round) > 0""")
def skip_closure(spark, sf):
    d = dag_defs(spark, sf)
    strict = d.filter(F.col("require_predecessor_success") | (F.col("id").cast("int") > 2)).select("run_id", F.col("id").alias("node"))
    return g.skip_closure(d.filter("bad > 0").select("run_id", F.col("id").alias("node")), g.edges(d, K), strict, K)


# ---- held tasks and cycles ----------------------------------------------------------

REACH = """reach(run_id, a, b) AS (SELECT run_id, pred, succ FROM inner_edge UNION SELECT r.run_id, r.a, e.succ FROM reach r JOIN inner_edge e ON e.run_id = r.run_id AND e.pred = r.b),
 ring AS (SELECT DISTINCT run_id, a AS node FROM reach WHERE a = b)"""
INNER = "inner_edge AS (SELECT * FROM dagedge e WHERE EXISTS (SELECT 1 FROM dag d WHERE d.run_id = e.run_id AND d.id = e.pred))"


@query("held_tasks", f"""WITH RECURSIVE {INNER}, {REACH}, behind AS (SELECT run_id, node FROM ring UNION SELECT r.run_id, r.b FROM reach r JOIN ring c ON c.run_id = r.run_id AND c.node = r.a),
 before AS (SELECT run_id, node FROM ring UNION SELECT r.run_id, r.a FROM reach r JOIN ring c ON c.run_id = r.run_id AND c.node = r.b)
 SELECT run_id, b.node, a.node IS NOT NULL AS ahead FROM behind b LEFT JOIN before a USING (run_id, node)""")
def held_tasks(spark, sf):
    return g.held(*_graph(spark, sf), K)


@query("cycle_path", f"""WITH RECURSIVE {INNER}, {REACH}, core AS (SELECT run_id, node FROM ring),
 f AS (SELECT e.run_id, e.succ AS node, min(e.pred) AS prev FROM inner_edge e JOIN core c ON c.run_id = e.run_id AND c.node = e.pred JOIN core d ON d.run_id = e.run_id AND d.node = e.succ GROUP BY ALL),
 walk(run_id, start, node, step) AS (SELECT run_id, node, prev, 1 FROM f UNION ALL SELECT w.run_id, w.start, f.prev, step + 1 FROM walk w JOIN f ON f.run_id = w.run_id AND f.node = w.node WHERE w.node <> w.start AND step < 8),
 closed AS (SELECT run_id, start AS node FROM walk WHERE node = start), least AS (SELECT run_id, min(node) AS least FROM closed GROUP BY run_id)
 SELECT run_id, CASE WHEN start = least THEN 0 ELSE step END AS step, start AS node FROM walk JOIN least USING (run_id) WHERE walk.node = least
   AND (run_id, start) IN (SELECT (w.run_id, w.node) FROM walk w JOIN least l ON l.run_id = w.run_id AND l.least = w.start)""")
def cycle_path(spark, sf):
    return g.cycles(*_graph(spark, sf), K)


# ---- gates: stages, wait marks, instances --------------------------------------------

W = ["workflow"]
STAGES = ("extract", "transform", "load")


def _staged(spark, sf):
    """Definitions whose predecessors are of the same workflow and of no later stage, so that the stages add no cycle."""
    d = definitions(spark, sf).select("workflow", "pos", "id", "stage", "predecessors")
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    wants = d.select("workflow", "id", at.alias("here"), F.explode("predecessors").alias("pred"))
    of = d.select("workflow", F.col("id").alias("pred"), at.alias("there"))
    fits = wants.join(of, ["workflow", "pred"]).where("there <= here").groupBy("workflow", "id").agg(F.collect_set("pred").alias("predecessors"))
    return d.drop("predecessors").join(fits, ["workflow", "id"], "left")


STAGED = """st AS (SELECT workflow, pos, id, list_position(['extract', 'transform', 'load'], stage) AS k, stage, preds FROM defs),
 task_edge AS (SELECT DISTINCT a.workflow, b.id AS pred, a.id AS succ FROM (SELECT workflow, id, k, unnest(preds) AS p FROM st) a JOIN st b ON b.workflow = a.workflow AND b.id = a.p AND b.k <= a.k),
 edge AS (SELECT workflow, pred, succ, 1 AS w FROM task_edge
   UNION ALL SELECT workflow, id, 'gate:' || k, 1 FROM st WHERE (workflow, k + 1) IN (SELECT (workflow, k) FROM st)
   UNION ALL SELECT workflow, 'gate:' || (k - 1), id, 0 FROM st WHERE (workflow, k - 1) IN (SELECT (workflow, k) FROM st))"""


@query("levels_stages", f"""WITH RECURSIVE {STAGED}, walk(workflow, node, depth) AS (SELECT workflow, id, 0 FROM st UNION SELECT w.workflow, e.succ, w.depth + e.w FROM walk w JOIN edge e ON e.workflow = w.workflow AND e.pred = w.node)
 SELECT workflow, node, max(depth) AS level FROM walk WHERE NOT starts_with(node, 'gate:') GROUP BY workflow, node""")
def levels_stages(spark, sf):
    return g.levels(*g.stage_graph(_staged(spark, sf), W, STAGES), W)


def _stage_state(stage):
    """Extraction is over but for a few tasks of one workflow, transformation in two workflows."""
    wf, k = F.col("workflow"), F.col("pos")
    over = ((stage == "extract") & ~((wf == "wf_4") & (k % 50 == 0))) | ((stage == "transform") & wf.isin("wf_0", "wf_1"))
    return F.when(over, F.when(k % 7 == 0, "failed").otherwise("completed")).otherwise("pending")


@query("ready_stages", f"""WITH {STAGED}, s AS (SELECT *, (stage = 'extract' AND NOT (workflow = 'wf_4' AND pos % 50 = 0)) OR (stage = 'transform' AND workflow IN ('wf_0', 'wf_1')) AS over FROM st),
 open_stage AS (SELECT workflow, k, bool_and(over) AS over FROM s GROUP BY workflow, k),
 blocked AS (SELECT DISTINCT e.workflow, e.succ AS id FROM task_edge e JOIN s ON s.workflow = e.workflow AND s.id = e.pred WHERE NOT over)
 SELECT workflow, id AS task_id, 1 AS instance_no FROM s WHERE NOT over AND (workflow, id) NOT IN (SELECT (workflow, id) FROM blocked)
   AND (workflow, k - 1) NOT IN (SELECT (workflow, k) FROM open_stage WHERE NOT over)""")
def ready_stages(spark, sf):
    d = _staged(spark, sf)
    state = _stage_state(F.col("stage"))
    inst = d.select("workflow", F.col("id").alias("task_id"), F.lit(1).alias("instance_no"), state.alias("state"), F.when(state == "completed", True).when(state == "failed", False).alias("success"))
    nodes, edge = g.stage_graph(d, W, STAGES)
    return g.ready_tasks(inst, edge, W, nodes.where("weight = 0"))


def _waits(spark, sf):
    d = definitions(spark, sf).select("workflow", "pos", "id")
    return w.wait_sequences(d, W, "pos", F.col("pos") % 37 == 0, block=1000)


WAITS = """wl AS (SELECT workflow, pos, id, sum(CASE WHEN pos % 37 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY workflow ORDER BY pos) AS sequence, pos % 37 = 0 AS is_wait FROM defs),
 wt AS (SELECT workflow, pos, id, dense_rank() OVER (PARTITION BY workflow ORDER BY sequence) - 1 AS level FROM wl WHERE NOT is_wait)"""


@query("levels_waits", f"WITH {WAITS} SELECT workflow, id AS node, level::INTEGER AS level FROM wt")
def levels_waits(spark, sf):
    return g.levels(*g.wait_graph(_waits(spark, sf), W), W)


@query("skip_waits", f"""WITH {WAITS}, failed AS (SELECT DISTINCT workflow, level FROM wt WHERE pos % 1000 = 501)
 SELECT wt.workflow, id AS node, (wt.level - max(failed.level))::INTEGER AS round FROM wt JOIN failed ON failed.workflow = wt.workflow AND failed.level < wt.level
 WHERE pos % 1000 <> 501 GROUP BY wt.workflow, id, wt.level""")
def skip_waits(spark, sf):
    """Behind a failed task everything in later sequences fails, if all of it requires success."""
    sequences = _waits(spark, sf)
    nodes, edge = g.wait_graph(sequences, W)
    failed = sequences.where("pos % 1000 = 501").select("workflow", F.col("id").alias("node"))
    return g.skip_closure(failed, edge, nodes, W)


@query("levels_fan_out", """WITH RECURSIVE e AS (SELECT DISTINCT r.run_id, r.n AS succ, p.n AS pred FROM (SELECT run_id, n, unnest(preds) AS p FROM res) r JOIN res p ON p.run_id = r.run_id AND p.task_id = r.p),
 walk(run_id, n, depth) AS (SELECT DISTINCT run_id, n, 0 FROM res UNION SELECT w.run_id, e.succ, w.depth + 1 FROM walk w JOIN e ON e.run_id = w.run_id AND e.pred = w.n),
 lv AS (SELECT run_id, n, max(depth) AS level FROM walk GROUP BY run_id, n),
 o AS (SELECT *, row_number() OVER (PARTITION BY run_id, task_id ORDER BY id) AS k, count(*) OVER (PARTITION BY run_id, task_id) AS m FROM res)
 SELECT run_id, CASE WHEN m > 1 THEN task_id || '.' || k ELSE task_id END AS node, level FROM o JOIN lv USING (run_id, n)""")
def levels_fan_out(spark, sf):
    return g.levels(*g.fan_out_graph(results(spark, sf)), K)
