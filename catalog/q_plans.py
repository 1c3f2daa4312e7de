"""Estimates, contention and concurrency analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import SENSITIVITY, definitions, executions, runs as derived_runs
from runtally.operators import joins as j
from runtally.plans import contention as c, estimates as e
from runtally.session import cut


def runs(spark, sf):
    """Run headers are a stored table in practice; here they are derived, so keep them once."""
    return cut(derived_runs(spark, sf))


@query("runtime_estimates", """SELECT w.workflow, w.task_signature, CASE WHEN coalesce(sample_count, 0) > 0 THEN ewma ELSE default_estimate END AS ewma, coalesce(sample_count, 0) AS sample_count,
 CASE WHEN coalesce(sample_count, 0) = 0 THEN 0 ELSE least(1.0, sample_count / 10.0) * 0.5 + CASE WHEN sample_count = 1 THEN 0.25 ELSE (1 - least(1.0, cv)) * 0.5 END END AS confidence,
 coalesce(sample_count, 0) = 0 AS estimated FROM wfsig w JOIN wfdefault d ON d.workflow = w.workflow""", dbl="ewma,confidence")
def runtime_estimates(spark, sf):
    return e.runtime_estimates(executions(spark, sf))


@query("analyze_runs", "SELECT * FROM analysis", dbl="avg_duration,ewma,success_rate,confidence,std_dev,cv")
def analyze_runs(spark, sf):
    return e.analyze_runs(executions(spark, sf))


@query("confidence_summary", """SELECT workflow, count(*) AS tasks, count(*) FILTER (NOT estimated) AS with_history, count(*) FILTER (estimated) AS estimated,
 avg(confidence) FILTER (NOT estimated) AS avg_confidence, count(*) FILTER (NOT estimated AND confidence >= 0.8) AS high_confidence, max(run_count) AS runs_analyzed FROM analysis GROUP BY workflow""", dbl="avg_confidence")
def confidence_summary(spark, sf):
    return e.confidence_summary(e.analyze_runs(executions(spark, sf)))


@query("recommendations", """WITH m AS (SELECT workflow, avg(ewma) AS mean_estimate, count(*) FILTER (NOT estimated AND confidence < 0.5) AS low_confidence, count(*) FILTER (estimated) AS no_history FROM analysis GROUP BY workflow),
 s AS (SELECT a.workflow, CASE WHEN length(a.task_id) > 16 THEN substr(a.task_id, 1, 16) || '...' ELSE a.task_id END AS label, row_number() OVER (PARTITION BY a.workflow ORDER BY estimated, a.task_signature) AS rn
   FROM analysis a JOIN m ON m.workflow = a.workflow WHERE a.ewma > 2 * m.mean_estimate)
 SELECT m.workflow, low_confidence, no_history, mean_estimate, count(s.rn) AS slow_tasks, coalesce(string_agg(label, ', ' ORDER BY rn) FILTER (rn <= 5), '') AS slow_labels
 FROM m LEFT JOIN s ON s.workflow = m.workflow GROUP BY m.workflow, low_confidence, no_history, mean_estimate""", dbl="mean_estimate:4")
def recommendations(spark, sf):
    return e.recommendations(e.analyze_runs(executions(spark, sf)))


def _tp(spark, sf):
    t = executions(spark, sf)
    from runtally.operators.windows import ewma
    return c.with_ewma(c.latest_task_params(runs(spark, sf), t), ewma(t))


def _impact(spark, sf):
    tp = _tp(spark, sf)
    return c.parameter_impact(c.parameter_groups(tp, c.varying_parameters(tp)))


def _analysis(spark, sf):
    return c.analyze(runs(spark, sf), executions(spark, sf), SENSITIVITY)


@query("varying_parameters", "SELECT * FROM varying")
def varying_parameters(spark, sf):
    return c.varying_parameters(c.latest_task_params(runs(spark, sf), executions(spark, sf)))


@query("parameter_impact", "SELECT * FROM impact", dbl="range_seconds")
def parameter_impact(spark, sf):
    return _impact(spark, sf)


@query("worker_levels", "SELECT * FROM levels", dbl="wall_clock,total_task_time,avg_task_duration,effective_parallelism,efficiency")
def worker_levels(spark, sf):
    return c.worker_levels(runs(spark, sf), executions(spark, sf))


@query("concurrency_corr", "SELECT * FROM corrs", dbl="correlation")
def concurrency_corr(spark, sf):
    return c.concurrency_correlation(executions(spark, sf))


@query("fan_out_size", "SELECT * FROM fan")
def fan_out_size(spark, sf):
    tp = _tp(spark, sf)
    varying = c.varying_parameters(tp)
    drivers = c.contention_driver(c.parameter_impact(c.parameter_groups(tp, varying)))
    return c.fan_out(tp, varying, drivers).withColumn("fan_out_keys", F.array_join("fan_out_keys", ","))


@query("contention_driver", "SELECT * FROM drivers", dbl="range_seconds,runner_up")
def contention_driver(spark, sf):
    return c.contention_driver(_impact(spark, sf))


@query("contention_groups", "SELECT * FROM cg", dbl="avg_duration,q1,q3,iqr,upper_fence")
def contention_groups(spark, sf):
    return _analysis(spark, sf).groups


@query("chain_edges", "SELECT * FROM chains")
def chain_edges(spark, sf):
    return _analysis(spark, sf).chains


@query("recommend_workers", "SELECT * FROM workers", dbl="critical_path,light_work")
def recommend_workers(spark, sf):
    return _analysis(spark, sf).workers.withColumn("fan_out_keys", F.array_join("fan_out_keys", ","))


@query("concurrency_ceiling", "SELECT * FROM ceiling", dbl="wall_clock_improvement:1,wall_clock_improvement_pct:1,correlation:4,efficiency:3")
def concurrency_ceiling(spark, sf):
    return c.concurrency_ceiling(runs(spark, sf), executions(spark, sf))


REPORT = """
w AS (SELECT DISTINCT workflow FROM ex),
kn AS (SELECT DISTINCT workflow FROM sigs JOIN ewmas USING (task_signature)),
rg AS (SELECT workflow, string_agg(key || '=' || printf('%.1f', range_seconds) || 's', ', ' ORDER BY rn) AS ranges
  FROM (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY range_seconds DESC, key) AS rn FROM impact) WHERE rn <= 3 GROUP BY workflow),
ln AS (SELECT workflow, count(DISTINCT task_id) AS chained FROM chains GROUP BY workflow),
cs AS (SELECT w.workflow, d.driver, k.* EXCLUDE (workflow), rg.ranges, ln.chained, ce.ceiling_workers, ce.confidence AS ck,
  CASE WHEN w.workflow NOT IN (SELECT workflow FROM kn) THEN 'no_history' WHEN w.workflow NOT IN (SELECT workflow FROM tp) THEN 'no_tasks'
    WHEN w.workflow NOT IN (SELECT workflow FROM varying) THEN 'no_varying' WHEN d.driver IS NULL THEN 'no_driver' WHEN heavy_groups < 2 THEN 'few_heavy' ELSE 'chains' END AS case_
  FROM w LEFT JOIN drivers d USING (workflow) LEFT JOIN workers k USING (workflow) LEFT JOIN rg USING (workflow) LEFT JOIN ln USING (workflow) LEFT JOIN ceiling ce USING (workflow)),
rep AS (SELECT workflow, driver AS contention_driver, coalesce(fan_out_keys, '') AS fan_out_keys, coalesce(fan_out_size, 0) AS fan_out_size, coalesce(heavy_groups, 0) AS chain_length,
  coalesce(heavy_tasks, 0) AS heavy_task_count, coalesce(light_tasks, 0) AS light_task_count, coalesce(critical_path, 0) AS critical_path_seconds, coalesce(chained, 0) AS chained_tasks,
  CASE WHEN case_ = 'chains' THEN CASE WHEN ck = 'scale_up' THEN greatest(recommended_workers, ceiling_workers) WHEN ck IS NOT NULL THEN least(recommended_workers, ceiling_workers) ELSE recommended_workers END
    WHEN case_ = 'few_heavy' THEN recommended_workers WHEN case_ IN ('no_varying', 'no_driver') THEN coalesce(ceiling_workers, 0) ELSE 0 END AS recommended_workers,
  CASE WHEN case_ IN ('no_varying', 'no_driver', 'chains') THEN ceiling_workers END AS concurrency_ceiling,
  CASE WHEN case_ IN ('no_varying', 'no_driver', 'chains') THEN ck END AS ceiling_kind,
  CASE case_ WHEN 'no_history' THEN 'No historical data found for workflow' WHEN 'no_tasks' THEN 'No task data found for workflow'
    WHEN 'no_varying' THEN 'No varying parameters found — all tasks have identical parameters'
    WHEN 'no_driver' THEN 'Could not identify a clear contention-driving parameter' || coalesce(' (ranges: ' || ranges || ')', '')
    WHEN 'few_heavy' THEN 'Only ' || heavy_groups || ' heavy group(s) detected — chaining requires at least 2' END AS warning FROM cs)"""


@query("contention_report", f"WITH {REPORT} SELECT * FROM rep", dbl="critical_path_seconds:1")
def contention_report(spark, sf):
    return c.contention_report(runs(spark, sf), executions(spark, sf), SENSITIVITY)


@query("optimization_choice", f"""WITH {REPORT} SELECT workflow, CASE WHEN contention_driver IS NULL AND concurrency_ceiling IS NULL THEN 'longest_first' WHEN chained_tasks > 0 THEN 'chains'
 WHEN concurrency_ceiling IS NOT NULL THEN 'ceiling' ELSE 'longest_first' END AS choice, recommended_workers FROM rep""")
def optimization_choice(spark, sf):
    return c.optimization_choice(c.contention_report(runs(spark, sf), executions(spark, sf), SENSITIVITY))


@query("driver_major_order", """WITH l AS (SELECT workflow, task_id, max(predecessor) AS p FROM chains GROUP BY workflow, task_id),
 t AS (SELECT d.*, CASE (SELECT driver FROM drivers x WHERE x.workflow = d.workflow) WHEN 'pSegment' THEN coalesce(p_seg, '') WHEN 'pPeriod' THEN coalesce(p_per, '') END AS dv FROM defs d)
 SELECT t.workflow, t.id, coalesce(l.p, array_to_string(preds, ',')) AS predecessors, recommended_workers,
 row_number() OVER (PARTITION BY t.workflow ORDER BY CASE WHEN is_heavy THEN 0 WHEN avg_duration IS NOT NULL THEN 1 ELSE 2 END, avg_duration DESC NULLS LAST,
   CASE WHEN avg_duration IS NOT NULL THEN dv END NULLS FIRST, pos) AS new_pos
 FROM t LEFT JOIN cg ON cg.workflow = t.workflow AND cg.driver_value = t.dv LEFT JOIN l ON l.workflow = t.workflow AND l.task_id = t.id LEFT JOIN workers k ON k.workflow = t.workflow""")
def driver_major_order(spark, sf):
    a = _analysis(spark, sf)
    groups = a.groups.select("workflow", "driver", "driver_value", "avg_duration", "is_heavy")
    return j.driver_major_order(definitions(spark, sf), groups, a.chains, a.workers).select(
        "workflow", "id", F.array_join("predecessors", ",").alias("predecessors"), "recommended_workers", "new_pos")
