"""The driver's tables seen as run history, on Spark and, as CTEs, in SQL.

events     -> ``ex`` executions and ``runs``: one run per day and workflow
lineitem   -> ``res`` results in which a task id has several instances; ``dag`` graphs
orders     -> ``defs`` task definitions, ``raw`` faulty ones, ``sess`` sessions
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from runtally.functions.scalars import task_signature
from runtally.schemas import RUNS, TASKS, conform


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _s(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _plus(start: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(start) + F.round(seconds * 1000).cast("long") * 1000)


def _params(**kv: Column) -> Column:
    return F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)])


def executions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u = F.col("user_id")
    wf, g = u % 5, F.floor(u / 5)
    seg, chore = g % 10, u % 11 == 10
    weight = F.when((wf < 3) & (seg == 8), 40).when((wf < 3) & (seg == 9), 30).otherwise(1)
    d = F.when(F.col("event_id") % 499 == 7, None).when(F.col("event_id") % 251 == 3, 0.0) \
        .otherwise(F.round(F.col("value") * 60 * weight, 3))
    failed = F.col("event_type") == "error"
    empty = F.create_map().cast("map<string,string>")
    out = e.select(
        F.col("event_id").alias("id"),
        F.concat((F.year("ts") * 10000 + F.month("ts") * 100 + F.day("ts")).cast("string"), F.lit("_"), wf.cast("string")).alias("run_id"),
        _s("wf_", wf).alias("workflow"), u.cast("string").alias("task_id"), _s("srv", u % 3).alias("instance"),
        F.when(~chore, _s("p", u % 20)).alias("process"), F.when(chore, _s("c", u % 4)).alias("chore"),
        F.when(chore, empty).otherwise(_params(
            pSegment=_s("s", seg), pPeriod=_s("m", F.floor(g / 10) % 3), pMode=F.lit("full"))).alias("parameters"),
        F.when(failed, "Fail").otherwise("Success").alias("status"), F.col("ts").alias("start_time"),
        d.alias("duration_seconds"),
        (F.regexp_extract("props", r'"k": (\d+)', 1).cast("int") % 3).alias("retry_count"),
        F.when(failed, _s("error ", u % 7)).alias("error_message"),
        F.when(g > 0, F.array((F.floor((g - 1) / 2) * 5 + wf).cast("string"))).alias("predecessors"),
        F.when(u % 4 == 0, "extract").when(u % 4 == 1, "transform").when(u % 4 == 2, "load").alias("stage"),
        (u % 2 == 0).alias("safe_retry"), F.when(u % 6 == 0, 300).alias("timeout"),
        F.when(u % 9 != 0, u % 9 == 1).alias("cancel_at_timeout"),
        (u % 3 == 0).alias("require_predecessor_success"), (u % 8 == 0).alias("succeed_on_minor_errors"))
    out = out.withColumn("end_time", _plus(F.col("start_time"), F.col("duration_seconds"))) \
        .withColumn("task_signature", task_signature("instance", "process", "parameters", "chore"))
    return conform(out, TASKS)


def runs(spark: SparkSession, sf: str) -> DataFrame:
    t = executions(spark, sf).groupBy("run_id", "workflow").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.count("*").alias("n"), F.count_if(F.col("status") == "Success").alias("good"))
    day = F.substring("run_id", 7, 2).cast("int")
    wall = (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6
    part = day % 9 == 0
    out = t.select(
        "run_id", "workflow", F.concat(F.lit("archive/"), "workflow", F.lit("/"), "run_id", F.lit(".json")).alias("taskfile_path"),
        "start_time", "end_time", F.when(day != 13, F.round(wall, 3)).alias("duration_seconds"),
        F.when(day % 7 == 0, "Failed").when(day % 5 == 0, "Partial").otherwise("Success").alias("status"),
        F.when(~part, F.col("n")).alias("task_count"), F.when(~part, F.col("good")).alias("success_count"),
        F.when(~part, F.col("n") - F.col("good")).alias("failure_count"),
        _s("name ", day % 4).alias("taskfile_name"), _s("about ", day % 3).alias("taskfile_description"),
        _s("author ", day % 2).alias("taskfile_author"), F.when(day != 17, 5 * (1 + day % 4)).alias("max_workers"),
        (day % 3).alias("retries"), F.lit("out.csv").alias("result_file"), (day % 6 == 0).alias("exclusive"),
        F.when(day % 4 != 0, day % 4 == 1).alias("optimize"), F.lit("longest_first").alias("optimization_algorithm"))
    return conform(out, RUNS)


def results(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    n, failed = F.col("l_linenumber"), F.col("l_returnflag") == "R"
    out = li.select(
        (((F.col("l_partkey") * 100000 + F.col("l_suppkey")) * 10 + n) * 100 + F.col("l_quantity").cast("long")).alias("id"),
        F.col("l_orderkey").cast("string").alias("run_id"), _s("wf_", F.col("l_orderkey") % 5).alias("workflow"),
        n.cast("string").alias("task_id"), _s("srv", n % 3).alias("instance"), _s("p", n).alias("process"),
        _params(pPart=F.col("l_partkey").cast("string"), pSupp=F.col("l_suppkey").cast("string")).alias("parameters"),
        F.when(failed, "Fail").otherwise("Success").alias("status"), F.col("ts").alias("start_time"),
        F.col("l_quantity").alias("duration_seconds"), (F.col("l_suppkey") % 3).alias("retry_count"),
        F.when(failed, _s("E", F.col("l_suppkey") % 5)).alias("error_message"),
        F.when(n > 1, F.array((n - 1).cast("string"), F.floor(n / 2).cast("string"))).alias("predecessors"),
        F.when(n % 2 == 0, "load").alias("stage"), F.lit(False).alias("safe_retry"))
    out = out.withColumn("end_time", _plus(F.col("start_time"), F.col("duration_seconds")))
    return conform(out, TASKS)


def dag_defs(spark: SparkSession, sf: str) -> DataFrame:
    """One graph per order; every 97th has a cycle; predecessors may not exist."""
    d = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("bad"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    text = lambda c: c.cast("string")
    preds = F.when(n > 2, F.array(text(n - 1), text(F.floor(n / 2)))).when(n == 2, F.array(F.lit("1"))) \
        .when(o % 97 == 0, F.array(F.lit("3"))).otherwise(F.array().cast("array<string>"))
    return d.select(o.alias("run_id"), text(n).alias("id"), preds.alias("predecessors"), "bad", "open",
                    (n % 2 == 0).alias("require_predecessor_success"))


def definitions(spark: SparkSession, sf: str) -> DataFrame:
    o, k, c = table(spark, sf, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    chore = k % 10 == 9
    half, third = F.floor((k + 1) / 2).cast("string"), F.floor((k + 1) / 3).cast("string")
    preds = F.when(k == 0, F.array().cast("array<string>")) \
        .when((k + 1) % 3 == 0, F.array(half, third)).otherwise(F.array(half))
    status = F.col("o_orderstatus")
    return o.select(
        _s("wf_", c % 5).alias("workflow"), F.lit(None).cast("string").alias("run_id"), k.alias("pos"),
        (k + 1).cast("string").alias("id"), _s("srv", c % 3).alias("instance"),
        F.when(~chore, _s("p", c % 20)).alias("process"), F.when(chore, _s("c", c % 4)).alias("chore"),
        F.when(chore, F.create_map().cast("map<string,string>")).otherwise(
            _params(pSegment=_s("s", c % 10), pPeriod=_s("m", k % 4))).alias("parameters"),
        preds.alias("predecessors"),
        F.when(status == "F", "extract").when(status == "O", "transform").otherwise("load").alias("stage"),
        (c % 2 == 0).alias("safe_retry"), F.when(k % 6 == 0, 300).alias("timeout"),
        (k % 7 == 0).alias("cancel_at_timeout"), (k % 3 == 0).alias("require_predecessor_success"),
        (k % 8 == 0).alias("succeed_on_minor_errors"))


def faulty_definitions(spark: SparkSession, sf: str) -> DataFrame:
    d, k = definitions(spark, sf).withColumnRenamed("workflow", "file"), F.col("pos")
    return d.withColumn("id", F.when(k % 13 == 1, F.concat(F.lit("x"), "id")).when(k % 41 == 2, F.lit("")).otherwise(F.col("id"))) \
        .withColumn("instance", F.when(k % 19 != 0, F.col("instance"))) \
        .withColumn("chore", F.when(k % 17 == 3, F.lit("c9")).otherwise(F.col("chore"))) \
        .withColumn("process", F.when(k % 31 != 4, F.col("process"))) \
        .withColumn("timeout", F.when(k % 23 == 5, -1).otherwise(F.col("timeout")))


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    start = F.col("o_orderdate").cast("timestamp")
    length = F.floor(F.col("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("session"), _s("srv", F.col("o_custkey") % 20).alias("instance"),
                    start.alias("start_time"),
                    F.timestamp_micros(F.unix_micros(start) + length.cast("long") * 1_000_000).alias("end_time"),
                    (F.col("o_orderpriority") == "1-URGENT").alias("exclusive"))


# ---- the same in SQL --------------------------------------------------------

CTES: dict[str, str] = {
    "ex0": """
SELECT event_id AS id, user_id AS u, user_id % 5 AS wf, user_id // 5 AS g, (user_id // 5) % 10 AS seg,
       ((user_id // 5) // 10) % 3 AS per, user_id % 11 = 10 AS is_chore, event_type = 'error' AS failed, ts,
       CASE WHEN event_id % 499 = 7 THEN NULL WHEN event_id % 251 = 3 THEN 0.0::DOUBLE ELSE
         CAST(round(CAST(value AS DECIMAL(18,2)) * 60 * CASE WHEN user_id % 5 < 3 AND (user_id // 5) % 10 = 8 THEN 40
           WHEN user_id % 5 < 3 AND (user_id // 5) % 10 = 9 THEN 30 ELSE 1 END, 3) AS DOUBLE) END AS duration_seconds,
       CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) % 3 AS retry_count
FROM events""",
    "ex": """
SELECT id, strftime(ts, '%Y%m%d') || '_' || wf AS run_id, 'wf_' || wf AS workflow, CAST(u AS VARCHAR) AS task_id,
       substr(sha256(CASE WHEN is_chore THEN 'chore|srv' || (u % 3) || '|c' || (u % 4)
         ELSE 'srv' || (u % 3) || '|p' || (u % 20) || '|{"pMode": "full", "pPeriod": "m' || per || '", "pSegment": "s' || seg || '"}' END), 1, 16) AS task_signature,
       'srv' || (u % 3) AS instance, CASE WHEN NOT is_chore THEN 'p' || (u % 20) END AS process,
       CASE WHEN is_chore THEN 'c' || (u % 4) END AS chore,
       CASE WHEN is_chore THEN '{}' ELSE '{"pSegment": "s' || seg || '", "pPeriod": "m' || per || '", "pMode": "full"}' END AS params,
       CASE WHEN NOT is_chore THEN 's' || seg END AS p_seg, CASE WHEN NOT is_chore THEN 'm' || per END AS p_per,
       CASE WHEN failed THEN 'Fail' ELSE 'Success' END AS status, ts AS start_time,
       ts + to_microseconds(CAST(round(duration_seconds * 1000) AS BIGINT) * 1000) AS end_time, duration_seconds, retry_count,
       CASE WHEN failed THEN 'error ' || (u % 7) END AS error_message,
       CASE WHEN g > 0 THEN CAST(((g - 1) // 2) * 5 + wf AS VARCHAR) END AS pred,
       CASE u % 4 WHEN 0 THEN 'extract' WHEN 1 THEN 'transform' WHEN 2 THEN 'load' END AS stage,
       u % 2 = 0 AS safe_retry, CASE WHEN u % 6 = 0 THEN 300 END AS timeout,
       CASE WHEN u % 9 <> 0 THEN u % 9 = 1 END AS cancel_at_timeout,
       u % 3 = 0 AS require_predecessor_success, u % 8 = 0 AS succeed_on_minor_errors,
       coalesce(CASE WHEN is_chore THEN 'c' || (u % 4) END, 'p' || (u % 20)) AS task_target,
       CASE WHEN is_chore THEN 'chore' ELSE 'process' END AS task_kind, u
FROM ex0""",
    "runs0": """
SELECT run_id, workflow, min(start_time) AS start_time, max(end_time) AS end_time, count(*) AS n,
       count(*) FILTER (status = 'Success') AS good, CAST(substr(run_id, 7, 2) AS INTEGER) AS day
FROM ex GROUP BY run_id, workflow""",
    "runs": """
SELECT run_id, workflow, 'archive/' || workflow || '/' || run_id || '.json' AS taskfile_path, start_time, end_time,
       CASE WHEN day <> 13 THEN CAST(round(CAST((epoch_us(end_time) - epoch_us(start_time)) AS DECIMAL(28,6)) / 1000000, 3) AS DOUBLE) END AS duration_seconds,
       CASE WHEN day % 7 = 0 THEN 'Failed' WHEN day % 5 = 0 THEN 'Partial' ELSE 'Success' END AS status,
       CASE WHEN day % 9 <> 0 THEN n END AS task_count, CASE WHEN day % 9 <> 0 THEN good END AS success_count,
       CASE WHEN day % 9 <> 0 THEN n - good END AS failure_count,
       'name ' || (day % 4) AS taskfile_name, 'about ' || (day % 3) AS taskfile_description,
       'author ' || (day % 2) AS taskfile_author, CASE WHEN day <> 17 THEN 5 * (1 + day % 4) END AS max_workers,
       day % 3 AS retries, 'out.csv' AS result_file, day % 6 = 0 AS exclusive,
       CASE WHEN day % 4 <> 0 THEN day % 4 = 1 END AS optimize, 'longest_first' AS optimization_algorithm
FROM runs0""",
    "res": """
SELECT ((l_partkey * 100000 + l_suppkey) * 10 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS id, CAST(l_orderkey AS VARCHAR) AS run_id,
       'wf_' || (l_orderkey % 5) AS workflow, CAST(l_linenumber AS VARCHAR) AS task_id, l_linenumber AS n,
       'srv' || (l_linenumber % 3) AS instance, 'p' || l_linenumber AS process,
       '{"pPart": "' || l_partkey || '", "pSupp": "' || l_suppkey || '"}' AS params,
       CASE WHEN l_returnflag = 'R' THEN 'Fail' ELSE 'Success' END AS status, CAST(l_shipdate AS TIMESTAMP) AS start_time,
       CAST(l_shipdate AS TIMESTAMP) + to_microseconds(CAST(l_quantity * 1000000 AS BIGINT)) AS end_time,
       l_quantity AS duration_seconds, CAST(l_suppkey % 3 AS INTEGER) AS retry_count,
       CASE WHEN l_returnflag = 'R' THEN 'E' || (l_suppkey % 5) END AS error_message,
       CASE WHEN l_linenumber > 1 THEN [CAST(l_linenumber - 1 AS VARCHAR), CAST(l_linenumber // 2 AS VARCHAR)] END AS preds,
       CASE WHEN l_linenumber % 2 = 0 THEN 'load' END AS stage
FROM lineitem""",
    "dag": """
SELECT l_orderkey AS run_id, CAST(l_linenumber AS VARCHAR) AS id,
       CASE WHEN l_linenumber > 2 THEN [CAST(l_linenumber - 1 AS VARCHAR), CAST(l_linenumber // 2 AS VARCHAR)]
            WHEN l_linenumber = 2 THEN ['1'] WHEN l_orderkey % 97 = 0 THEN ['3'] ELSE [] END AS preds,
       count(*) FILTER (l_returnflag = 'R') AS bad, count(*) FILTER (l_linestatus = 'O') AS open,
       l_linenumber % 2 = 0 AS require_predecessor_success
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "dagedge": "SELECT DISTINCT run_id, unnest(preds) AS pred, id AS succ FROM dag",
    "defs": """
SELECT 'wf_' || (o_custkey % 5) AS workflow, o_orderkey AS pos, CAST(o_orderkey + 1 AS VARCHAR) AS id,
       'srv' || (o_custkey % 3) AS instance, CASE WHEN o_orderkey % 10 <> 9 THEN 'p' || (o_custkey % 20) END AS process,
       CASE WHEN o_orderkey % 10 = 9 THEN 'c' || (o_custkey % 4) END AS chore,
       CASE WHEN o_orderkey % 10 <> 9 THEN 's' || (o_custkey % 10) END AS p_seg,
       CASE WHEN o_orderkey % 10 <> 9 THEN 'm' || (o_orderkey % 4) END AS p_per,
       CASE WHEN o_orderkey = 0 THEN []
            WHEN (o_orderkey + 1) % 3 = 0 THEN [CAST((o_orderkey + 1) // 2 AS VARCHAR), CAST((o_orderkey + 1) // 3 AS VARCHAR)]
            ELSE [CAST((o_orderkey + 1) // 2 AS VARCHAR)] END AS preds,
       CASE o_orderstatus WHEN 'F' THEN 'extract' WHEN 'O' THEN 'transform' ELSE 'load' END AS stage,
       o_custkey % 2 = 0 AS safe_retry, CASE WHEN o_orderkey % 6 = 0 THEN 300 END AS timeout,
       o_orderkey % 7 = 0 AS cancel_at_timeout, o_orderkey % 3 = 0 AS require_predecessor_success,
       o_orderkey % 8 = 0 AS succeed_on_minor_errors, o_custkey AS cust
FROM orders""",
    "raw": """
SELECT workflow AS file, pos, CASE WHEN pos % 13 = 1 THEN 'x' || id WHEN pos % 41 = 2 THEN '' ELSE id END AS id,
       CASE WHEN pos % 19 <> 0 THEN instance END AS instance, CASE WHEN pos % 17 = 3 THEN 'c9' ELSE chore END AS chore,
       CASE WHEN pos % 31 <> 4 THEN process END AS process, CASE WHEN pos % 23 = 5 THEN -1 ELSE timeout END AS timeout,
       p_seg IS NOT NULL AS has_params, succeed_on_minor_errors, cancel_at_timeout, preds
FROM defs""",
    "sess": """
SELECT o_orderkey AS session, 'srv' || (o_custkey % 20) AS instance, CAST(o_orderdate AS TIMESTAMP) AS start_time,
       CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) AS end_time,
       o_orderpriority = '1-URGENT' AS exclusive
FROM orders""",
    # Newest ten successes per signature and their damped average.
    "hist": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_signature ORDER BY start_time DESC, id DESC) AS rn
               FROM ex WHERE status = 'Success') WHERE rn <= 10""",
    "ewmas": """
SELECT task_signature, list_reduce(list(duration_seconds ORDER BY rn), lambda e, d:
         0.3 * CASE WHEN e > 0 AND d > e * 3.0 THEN least(d, e * 2.0) ELSE d END + 0.7 * e) AS ewma
FROM hist WHERE duration_seconds IS NOT NULL GROUP BY task_signature""",
    "sigs": "SELECT DISTINCT workflow, task_signature FROM ex",
    "sighist0": """
SELECT task_signature, min_by(task_id, rn) AS task_id, count(*) AS history_count,
       list(duration_seconds ORDER BY rn) FILTER (duration_seconds IS NOT NULL AND duration_seconds <> 0) AS d,
       coalesce(stddev_samp(duration_seconds) FILTER (duration_seconds <> 0), 0) AS std,
       avg(duration_seconds) FILTER (duration_seconds <> 0) AS avg
FROM hist GROUP BY task_signature""",
    "sighist": """
SELECT task_signature, task_id, history_count, coalesce(len(d), 0) AS sample_count, avg, std,
       CASE WHEN avg > 0 THEN std / avg ELSE 1.0 END AS cv,
       CASE WHEN len(d) > 0 THEN list_reduce(d, lambda e, x:
         0.3 * CASE WHEN e > 0 AND x > e * 3.0 THEN least(x, e * 2.0) ELSE x END + 0.7 * e) END AS ewma
FROM sighist0""",
    "wfsig": "SELECT s.workflow, s.task_signature, h.* EXCLUDE (task_signature) FROM sigs s LEFT JOIN sighist h USING (task_signature)",
    "wfdefault": """
SELECT w.workflow, coalesce(avg(r.ewma) FILTER (r.rn <= greatest(1, r.n // 4)), 10.0) AS default_estimate
FROM (SELECT DISTINCT workflow FROM sigs) w LEFT JOIN (
  SELECT workflow, ewma, row_number() OVER (PARTITION BY workflow ORDER BY ewma) AS rn, count(*) OVER (PARTITION BY workflow) AS n
  FROM wfsig WHERE ewma > 0) r USING (workflow) GROUP BY w.workflow""",
    "overl": """
SELECT a.run_id, a.id, a.task_id, a.start_time, a.end_time, a.duration_seconds,
       (SELECT count(*) FROM ex b WHERE b.run_id = a.run_id AND b.id <> a.id
          AND b.start_time < a.end_time AND b.end_time > a.start_time) AS concurrent_count
FROM ex a WHERE a.status = 'Success'""",
    "recent5": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY start_time DESC, run_id DESC) AS rn FROM runs) WHERE rn <= 5""",
    "levels": """
SELECT workflow, max_workers, run_id, duration_seconds AS wall_clock, total AS total_task_time, task_count, avg_d AS avg_task_duration,
  CAST(round(CAST(total / duration_seconds AS DECIMAL(28,10)), 1) AS DOUBLE) AS effective_parallelism,
  CAST(round(CAST(total / duration_seconds / max_workers AS DECIMAL(28,10)), 3) AS DOUBLE) AS efficiency
FROM (SELECT workflow, max_workers, run_id, duration_seconds, row_number() OVER (PARTITION BY workflow, max_workers ORDER BY start_time DESC) AS k
      FROM runs WHERE status = 'Success' AND max_workers IS NOT NULL AND duration_seconds IS NOT NULL)
JOIN (SELECT run_id, sum(duration_seconds) AS total, count(*) AS task_count, avg(duration_seconds) AS avg_d FROM ex WHERE status = 'Success' GROUP BY run_id) USING (run_id)
WHERE k = 1""",
    "newest": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY start_time DESC) AS k FROM runs WHERE status = 'Success') WHERE k = 1""",
    "tp": "SELECT ex.*, ewmas.ewma FROM ex LEFT JOIN ewmas USING (task_signature) WHERE run_id IN (SELECT run_id FROM newest)",
    "tpkv": """
SELECT workflow, unnest(['pSegment', 'pPeriod', 'pMode']) AS key, unnest([p_seg, p_per, 'full']) AS value FROM tp WHERE p_seg IS NOT NULL""",
    "varying": "SELECT workflow, key, count(DISTINCT value) AS distinct_values FROM tpkv GROUP BY workflow, key HAVING count(DISTINCT value) > 1",
    "pgroups": """
SELECT workflow, key, coalesce(CASE key WHEN 'pSegment' THEN p_seg WHEN 'pPeriod' THEN p_per ELSE 'full' END, '') AS value,
       avg(ewma) AS avg_estimate, count(*) AS task_count
FROM tp JOIN varying USING (workflow) GROUP BY ALL""",
    "impact": """
SELECT workflow, key, count(*) AS distinct_values, max(avg_estimate) - min(avg_estimate) AS range_seconds
FROM pgroups WHERE avg_estimate IS NOT NULL GROUP BY workflow, key""",
    "drivers0": """
SELECT workflow, max(key) FILTER (rn = 1) AS widest, max(range_seconds) FILTER (rn = 1) AS range_seconds, max(range_seconds) FILTER (rn = 2) AS runner_up
FROM (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY range_seconds DESC, key) AS rn FROM impact) GROUP BY workflow""",
    "drivers": """
SELECT *, CASE WHEN NOT coalesce(runner_up > 0 AND range_seconds / runner_up < 5.0, false) THEN widest END AS driver FROM drivers0""",
    "tpf": """
SELECT tp.*, driver, CASE driver WHEN 'pSegment' THEN coalesce(p_seg, '') WHEN 'pPeriod' THEN coalesce(p_per, '') END AS driver_value,
       (SELECT coalesce(string_agg(key, ',' ORDER BY key), '') FROM varying v WHERE v.workflow = tp.workflow AND v.key <> driver) AS fan_out_keys,
       (SELECT coalesce(string_agg(CASE v.key WHEN 'pSegment' THEN coalesce(p_seg, '') WHEN 'pPeriod' THEN coalesce(p_per, '') END, '|' ORDER BY v.key), '')
        FROM varying v WHERE v.workflow = tp.workflow AND v.key <> driver) AS fan_out_value
FROM tp JOIN drivers USING (workflow) WHERE driver IS NOT NULL""",
    "fan": "SELECT workflow, fan_out_keys, count(DISTINCT fan_out_value) AS fan_out_size FROM tpf GROUP BY workflow, fan_out_keys",
    "cg0": """
SELECT d.workflow, d.driver, p.value AS driver_value, p.task_count, coalesce(p.avg_estimate, 0.0) AS avg_duration
FROM drivers d JOIN pgroups p ON p.workflow = d.workflow AND p.key = d.driver""",
    "cgq": """
SELECT workflow, count(*) AS n, list(avg_duration ORDER BY avg_duration) AS l FROM cg0 GROUP BY workflow""",
    "cg": """
SELECT cg0.*, CASE WHEN n >= 4 THEN l[n // 4 + 1] ELSE 0 END AS q1, CASE WHEN n >= 4 THEN l[(3 * n) // 4 + 1] ELSE 0 END AS q3,
  CASE WHEN n >= 4 THEN l[(3 * n) // 4 + 1] - l[n // 4 + 1] ELSE 0 END AS iqr,
  CASE WHEN n >= 4 THEN l[(3 * n) // 4 + 1] + {k} * (l[(3 * n) // 4 + 1] - l[n // 4 + 1]) ELSE 0 END AS upper_fence,
  n >= 4 AND avg_duration > l[(3 * n) // 4 + 1] + {k} * (l[(3 * n) // 4 + 1] - l[n // 4 + 1]) AS is_heavy
FROM cg0 JOIN cgq USING (workflow)""",
    "workers0": """
SELECT workflow, count(*) FILTER (is_heavy) AS heavy_groups, count(*) FILTER (NOT is_heavy) AS light_groups,
  coalesce(sum(task_count) FILTER (is_heavy), 0)::BIGINT AS heavy_tasks, coalesce(sum(task_count) FILTER (NOT is_heavy), 0)::BIGINT AS light_tasks,
  coalesce(sum(avg_duration) FILTER (is_heavy), 0) AS critical_path, coalesce(sum(avg_duration * task_count) FILTER (NOT is_heavy), 0) AS light_work
FROM cg GROUP BY workflow""",
    "workers1": """
SELECT w.*, fan_out_keys, fan_out_size, CASE WHEN heavy_groups = 0 THEN ceil(light_work)::BIGINT WHEN critical_path > 0 THEN ceil(light_work / critical_path)::BIGINT ELSE 0 END AS light_slots
FROM workers0 w JOIN fan USING (workflow)""",
    "workers": """
SELECT *, CASE WHEN heavy_groups < 2 THEN fan_out_size ELSE greatest(fan_out_size, fan_out_size + light_slots) END AS recommended_workers FROM workers1""",
    "chain_order": """
SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY avg_duration DESC, driver_value) AS chain_rank
FROM cg WHERE is_heavy AND workflow IN (SELECT workflow FROM workers WHERE heavy_groups >= 2)""",
    "chain_last": """
SELECT workflow, driver_value, fan_out_value, max_by(task_id, CAST(task_id AS BIGINT) * 1000000000 + id) AS task_id FROM tpf GROUP BY workflow, driver_value, fan_out_value""",
    "chains": """
SELECT a.workflow, l.fan_out_value, a.chain_rank, l.task_id, p.task_id AS predecessor
FROM chain_order a JOIN chain_last l ON l.workflow = a.workflow AND l.driver_value = a.driver_value
JOIN chain_order b ON b.workflow = a.workflow AND b.chain_rank = a.chain_rank - 1
JOIN chain_last p ON p.workflow = b.workflow AND p.driver_value = b.driver_value AND p.fan_out_value = l.fan_out_value""",
    "corrs": """
SELECT run_id, count(*) AS n, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(CASE WHEN isnan(corr(concurrent_count, duration_seconds)) THEN 0
  ELSE corr(concurrent_count, duration_seconds) END, 0) END AS correlation FROM overl GROUP BY run_id""",
    "ceil0": """
SELECT workflow, count(*) AS levels, min_by(max_workers, wall_clock) AS bw, min(wall_clock) AS bc, max_by(max_workers, wall_clock) AS ww,
  max(wall_clock) AS wc, min_by(effective_parallelism, wall_clock) AS beff FROM levels GROUP BY workflow HAVING count(*) >= 2""",
    "ceil1": """
SELECT n.workflow, n.max_workers AS now_workers, n.duration_seconds AS now_wall, c.*  EXCLUDE (workflow),
  (SELECT min(max_workers) FROM levels l WHERE l.workflow = n.workflow AND l.wall_clock <= c.bc * 1.10) AS sweet_w,
  (SELECT arg_min(wall_clock, max_workers) FROM levels l WHERE l.workflow = n.workflow AND l.wall_clock <= c.bc * 1.10) AS sweet_c,
  coalesce((SELECT wall_clock FROM levels l WHERE l.run_id = n.run_id), c.wc) AS here_c,
  k.n AS tasks, k.correlation, s.total / n.duration_seconds AS eff
FROM newest n LEFT JOIN ceil0 c USING (workflow) LEFT JOIN corrs k ON k.run_id = n.run_id
LEFT JOIN (SELECT run_id, sum(duration_seconds) AS total FROM ex WHERE status = 'Success' GROUP BY run_id) s ON s.run_id = n.run_id""",
    "ceil2": """
SELECT *, CASE WHEN bw < ww THEN 'multi_run' WHEN bw > ww AND bw > now_workers AND sweet_w > now_workers THEN 'scale_up'
  WHEN now_wall > 0 AND tasks >= 5 AND correlation >= 0.7 AND eff / now_workers < 0.75
   AND greatest(5, round_even(eff / 5.0, 0) * 5) < now_workers THEN 'single_run' END AS confidence FROM ceil1""",
    "ceiling": """
SELECT workflow, CASE confidence WHEN 'multi_run' THEN greatest(5, round_even(beff / 5.0, 0) * 5)::INTEGER WHEN 'scale_up' THEN sweet_w
    ELSE greatest(5, round_even(eff / 5.0, 0) * 5)::INTEGER END AS ceiling_workers, confidence,
  CASE confidence WHEN 'multi_run' THEN wc - bc WHEN 'scale_up' THEN here_c - sweet_c END AS wall_clock_improvement,
  CASE confidence WHEN 'multi_run' THEN (wc - bc) / wc * 100 WHEN 'scale_up' THEN (here_c - sweet_c) / here_c * 100 END AS wall_clock_improvement_pct,
  CASE confidence WHEN 'single_run' THEN correlation END AS correlation, CASE confidence WHEN 'single_run' THEN eff / now_workers END AS efficiency
FROM ceil2 WHERE confidence IS NOT NULL""",
    "analysis": """
SELECT workflow, task_signature, task_id, avg AS avg_duration, ewma, history_count AS run_count, 1.0 AS success_rate,
  least(1.0, history_count / 10.0) * 0.5 + (1 - least(1.0, CASE WHEN sample_count > 1 THEN cv ELSE 0 END)) * 0.5 AS confidence,
  std AS std_dev, CASE WHEN sample_count > 1 THEN cv ELSE 0 END AS cv, false AS estimated
FROM wfsig WHERE sample_count > 0
UNION ALL SELECT w.workflow, w.task_signature, w.task_signature, d.default_estimate, d.default_estimate, 0, 0.0, 0.0, 0.0, 0.0, true
FROM wfsig w JOIN wfdefault d ON d.workflow = w.workflow WHERE history_count IS NULL""",
}

# Multiplier of the interquartile range in the registered contention queries.
SENSITIVITY = 1.5
CTES["cg"] = CTES["cg"].replace("{k}", str(SENSITIVITY))
