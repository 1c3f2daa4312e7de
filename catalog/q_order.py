"""Windows, ordered folds, rankings and top-k reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.q_history import TASK_TABLE
from catalog.registry import query
from catalog.tables import definitions, executions, faulty_definitions, results, runs
from runtally.operators import history as h, windows as w
from runtally.plans.contention import worker_levels
from runtally.plans.estimates import per_workflow, analyze_runs, signature_history


@query("latest_executions", "SELECT task_signature, rn, id, run_id, start_time, duration_seconds FROM hist", dbl="duration_seconds:3", ts="start_time")
def latest_executions(spark, sf):
    return w.latest_executions(executions(spark, sf), 10).select("task_signature", "rn", "id", "run_id", "start_time", "duration_seconds")


@query("last_n_runs", """SELECT workflow, run_id, start_time, row_number() OVER (PARTITION BY workflow ORDER BY rn DESC) AS position FROM recent5""", ts="start_time")
def last_n_runs(spark, sf):
    return w.last_n_runs(runs(spark, sf), 5).select("workflow", "run_id", "start_time", "position")


@query("ewma", "SELECT task_signature, ewma FROM ewmas", dbl="ewma")
def ewma(spark, sf):
    return w.ewma(executions(spark, sf))


@query("confidence", """SELECT task_signature, sample_count, CASE WHEN sample_count = 0 THEN 0 ELSE least(1.0, sample_count / 10.0) * 0.5 +
 CASE WHEN sample_count = 1 THEN 0.25 ELSE (1 - least(1.0, cv)) * 0.5 END END AS confidence FROM sighist""", dbl="confidence")
def confidence(spark, sf):
    return w.confidence(executions(spark, sf))


@query("default_estimate", "SELECT workflow, default_estimate FROM wfdefault", dbl="default_estimate")
def default_estimate(spark, sf):
    t = executions(spark, sf)
    return w.default_estimate(per_workflow(t, signature_history(t)))


@query("concurrency_timeline", """WITH g AS (SELECT run_id, start_time AS t0, floor(coalesce(duration_seconds, 0))::BIGINT AS last FROM runs),
 m AS (SELECT run_id, start_time AS t, 1 AS d FROM ex WHERE end_time IS NOT NULL UNION ALL SELECT run_id, end_time, -1 FROM ex WHERE end_time IS NOT NULL),
 c AS (SELECT g.run_id, last, greatest(ceil((epoch_us(t) - epoch_us(t0)) / 1000000.0), 0)::BIGINT AS second, d FROM g JOIN m USING (run_id)
   UNION ALL SELECT run_id, last, 0, 0 FROM g),
 s AS (SELECT run_id, last, second, sum(d) AS d FROM c WHERE second <= last GROUP BY ALL HAVING sum(d) <> 0 OR second = 0)
 SELECT run_id, second, coalesce(lead(second) OVER w, last + 1) - 1 AS until, greatest(sum(d) OVER w, 0)::BIGINT AS count FROM s
 WINDOW w AS (PARTITION BY run_id ORDER BY second)""")
def concurrency_timeline(spark, sf):
    return w.concurrency_timeline(runs(spark, sf), executions(spark, sf))


@query("wait_sequences", """WITH l AS (SELECT workflow, pos, sum(CASE WHEN pos % 37 = 0 OR cust % 41 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY workflow ORDER BY pos) AS sequence,
   pos % 37 = 0 OR cust % 41 = 0 AS is_wait FROM defs),
 s AS (SELECT workflow, sequence, count(*) AS size FROM l WHERE NOT is_wait GROUP BY workflow, sequence),
 p AS (SELECT workflow, sequence, lag(sequence) OVER x AS previous, lag(size) OVER x AS previous_size FROM s WINDOW x AS (PARTITION BY workflow ORDER BY sequence))
 SELECT workflow, pos, sequence::BIGINT AS sequence, previous::BIGINT AS previous, previous_size FROM l JOIN p USING (workflow, sequence) WHERE NOT is_wait""")
def wait_sequences(spark, sf):
    d = definitions(spark, sf).join(spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("cust")), "pos")
    is_wait = (F.col("pos") % 37 == 0) | (F.col("cust") % 41 == 0)
    return w.wait_sequences(d.select("workflow", "pos", "cust"), ["workflow"], "pos", is_wait, block=1000) \
        .select("workflow", "pos", "sequence", "previous", "previous_size")


@query("renumber_results", """SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY n, start_time, id) AS VARCHAR) AS task_id,
 task_id AS original_task_id, id FROM res""")
def renumber_results(spark, sf):
    return w.renumber_results(results(spark, sf)).select("run_id", "task_id", "original_task_id", "id")


def _groups(spark, sf):
    return h.with_target(executions(spark, sf)).groupBy("workflow", F.col("task_id").alias("driver_value")).agg(
        F.avg("duration_seconds").alias("avg_duration")).filter("avg_duration IS NOT NULL")


GROUPS = """g AS (SELECT workflow, task_id AS driver_value, avg(duration_seconds) AS avg_duration FROM ex GROUP BY workflow, task_id HAVING avg(duration_seconds) IS NOT NULL),
 q AS (SELECT workflow, len(l) AS n, l[len(l) // 4 + 1] AS q1, l[(3 * len(l)) // 4 + 1] AS q3 FROM
   (SELECT workflow, list(avg_duration ORDER BY avg_duration) AS l FROM g GROUP BY workflow)),
 o AS (SELECT g.*, CASE WHEN n >= 4 THEN q1 ELSE 0 END AS q1, CASE WHEN n >= 4 THEN q3 ELSE 0 END AS q3, CASE WHEN n >= 4 THEN q3 - q1 ELSE 0 END AS iqr,
   CASE WHEN n >= 4 THEN q3 + 1.5 * (q3 - q1) ELSE 0 END AS upper_fence, n >= 4 AND avg_duration > q3 + 1.5 * (q3 - q1) AS is_heavy FROM g JOIN q USING (workflow))"""


@query("heavy_outliers", f"WITH {GROUPS} SELECT * FROM o", dbl="avg_duration,q1,q3,iqr,upper_fence")
def heavy_outliers(spark, sf):
    return w.heavy_outliers(_groups(spark, sf), ["workflow"], 1.5)


@query("heavy_rank", f"""WITH {GROUPS} SELECT workflow, driver_value, avg_duration,
 row_number() OVER (PARTITION BY workflow ORDER BY avg_duration DESC, driver_value) AS chain_rank FROM o WHERE is_heavy""", dbl="avg_duration")
def heavy_rank(spark, sf):
    return w.heavy_rank(w.heavy_outliers(_groups(spark, sf), ["workflow"], 1.5), ["workflow"]) \
        .select("workflow", "driver_value", "avg_duration", "chain_rank")


@query("task_history", """SELECT task_signature, rn, task_id, instance, process, run_id, start_time, end_time, coalesce(duration_seconds, 0) AS duration, status
 FROM (SELECT *, row_number() OVER (PARTITION BY task_signature ORDER BY start_time DESC, id DESC) AS rn FROM ex) WHERE rn <= 20""", dbl="duration:2", ts="start_time,end_time")
def task_history(spark, sf):
    return w.task_history(executions(spark, sf))


@query("best_worst_level", """SELECT workflow, count(*) AS levels, min_by(max_workers, wall_clock) AS best_workers, min(wall_clock) AS best_wall,
 max_by(max_workers, wall_clock) AS worst_workers, max(wall_clock) AS worst_wall FROM levels GROUP BY workflow""", dbl="best_wall,worst_wall")
def best_worst_level(spark, sf):
    return w.best_worst_level(worker_levels(runs(spark, sf), executions(spark, sf))).select(
        "workflow", "levels", F.col("best.max_workers").alias("best_workers"), F.col("best.wall_clock").alias("best_wall"),
        F.col("worst.max_workers").alias("worst_workers"), F.col("worst.wall_clock").alias("worst_wall"))


@query("order_ready", """SELECT run_id, stage, id, row_number() OVER (PARTITION BY run_id, stage ORDER BY coalesce(ewma, 10.0) DESC, id) AS dispatch_order
 FROM ex LEFT JOIN ewmas USING (task_signature)""")
def order_ready(spark, sf):
    t = executions(spark, sf)
    est = t.join(w.ewma(t), "task_signature", "left").select(
        "run_id", "stage", "id", F.col("id").alias("pos"), F.coalesce("ewma", F.lit(10.0)).alias("estimate"))
    return w.order_ready(est, ["run_id", "stage"]).select("run_id", "stage", "id", "dispatch_order")


TOP = """SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY duration_seconds DESC, id) AS rank FROM {src} WHERE duration_seconds IS NOT NULL"""


@query("slowest", f"""WITH t AS ({TOP.format(src='ex')}), m AS (SELECT workflow, median(duration_seconds) AS median FROM ex WHERE status = 'Success' GROUP BY workflow)
 SELECT workflow, rank, task_id, task_target, task_kind, instance, run_id, duration_seconds AS duration, status,
 CASE WHEN coalesce(median, 0) <> 0 THEN duration_seconds - median ELSE 0 END AS vs_median FROM t LEFT JOIN m USING (workflow) WHERE rank <= 20""",
       dbl="duration:2,vs_median:2")
def slowest(spark, sf):
    return w.slowest(executions(spark, sf))


@query("slowest_recent", f"""WITH e AS (SELECT * FROM ex WHERE run_id IN (SELECT run_id FROM recent5)), t AS ({TOP.format(src='e')}),
 m AS (SELECT workflow, l[len(l) // 2 + 1] AS median FROM (SELECT workflow, list(duration_seconds ORDER BY duration_seconds) AS l FROM e
   WHERE status = 'Success' AND duration_seconds IS NOT NULL GROUP BY workflow))
 SELECT workflow, rank, task_id, task_target, task_kind, instance, run_id, duration_seconds AS duration,
 duration_seconds - coalesce(median, 0) AS vs_median, status FROM t LEFT JOIN m USING (workflow) WHERE rank <= 10""", dbl="duration:2,vs_median:2")
def slowest_recent(spark, sf):
    return w.slowest_recent(executions(spark, sf), runs(spark, sf))


@query("task_page", f"SELECT task_signature, task_id, executions, avg FROM ({TASK_TABLE}) ORDER BY avg DESC, task_signature LIMIT 25 OFFSET 25", dbl="avg")
def task_page(spark, sf):
    return w.task_page(h.task_table(executions(spark, sf), runs(spark, sf), 5), page=1).select("task_signature", "task_id", "executions", "avg")


@query("natural_order", """SELECT file, pos, id, row_number() OVER (PARTITION BY file ORDER BY CASE WHEN CAST(try_cast(id AS HUGEINT) AS VARCHAR) = id THEN 0 ELSE 1 END,
 try_cast(id AS HUGEINT) NULLS FIRST, regexp_extract(id, '^(\\D*)', 1), length(ltrim(nullif(regexp_extract(id, '^\\D*(\\d+)', 1), ''), '0')) NULLS FIRST, ltrim(regexp_extract(id, '^\\D*(\\d+)', 1), '0'), id, pos) AS position
 FROM raw""")
def natural_order(spark, sf):
    d = faulty_definitions(spark, sf).select("file", "pos", "id")
    return w.natural_order(d, ["file"], "id", ["pos"])


@query("optimized_order", """SELECT workflow, task_signature, task_id, row_number() OVER (PARTITION BY workflow ORDER BY ewma DESC, estimated, task_signature) AS order
 FROM analysis""".replace("AS order", 'AS "order"'))
def optimized_order(spark, sf):
    return w.optimized_order(analyze_runs(executions(spark, sf))).select("workflow", "task_signature", "task_id", "order")
