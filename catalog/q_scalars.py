"""Scalar expressions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.tables import definitions, executions, table
from runtally.functions import scalars as s


@query("task_signature", "SELECT id, task_signature FROM ex")
def task_signature(spark, sf):
    return executions(spark, sf).select("id", s.task_signature("instance", "process", "parameters", "chore").alias("task_signature"))


@query("parse_params", """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN '{"pKey": "' || o_orderkey || '", "pPri": "' || o_orderpriority || '"}'
 WHEN 1 THEN '{"pKey": "' || o_orderkey || '", "pPri": "' || o_orderpriority || '"}' WHEN 2 THEN '{"pDir": "D:\\\\stock\\\\' || o_custkey || '\\\\"}' ELSE '{}' END AS params FROM orders""")
def parse_params(spark, sf):
    k, pri = F.col("o_orderkey").cast("string"), F.col("o_orderpriority")
    n = F.col("o_orderkey") % 4
    text = (F.when(n == 0, F.concat(F.lit('{"pKey": "'), k, F.lit('", "pPri": "'), pri, F.lit('"}')))
            .when(n == 1, F.concat(F.lit(" pKey="), k, F.lit(' junk pPri="'), pri, F.lit('"')))
            .when(n == 2, F.concat(F.lit('pDir="D:\\stock\\'), F.col("o_custkey").cast("string"), F.lit('\\"')))
            .otherwise(F.concat(F.lit('pBad="'), pri)))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), s.json_map(s.parse_params(text)).alias("params"))


@query("tokenize_line", """SELECT o_orderkey AS k, 'id=' || o_orderkey || '|pri=' || o_orderpriority || ' x|path=a\\b|' || o_orderstatus || 'z' AS tokens FROM orders""")
def tokenize_line(spark, sf):
    text = F.concat(F.lit("  id="), F.col("o_orderkey").cast("string"), F.lit(' pri="'), "o_orderpriority", F.lit(' x"\t path=a\\b '),
                    F.lit("'"), "o_orderstatus", F.lit("'z  "))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.array_join(s.tokenize_line(text), "|").alias("tokens"))


@query("parse_bool", """SELECT event_id, lower(event_type) = 'true' OR user_id % 5 IN (0, 1) AS cube, user_id % 5 IN (0, 1, 2) AS line FROM events""")
def parse_bool(spark, sf):
    words = F.array(F.lit("TRUE"), F.lit("Yes"), F.lit("Y"), F.lit("no"), F.lit(""))
    w = F.get(words, (F.col("user_id") % 5).cast("int"))
    return table(spark, sf, "events").select("event_id", s.parse_bool(w).alias("cube"), s.parse_bool(w, line=True).alias("line"))


@query("predecessor_list", """SELECT pos, CASE WHEN pos % 3 = 0 THEN '' ELSE coalesce(array_to_string(list_transform(preds, lambda p: ' ' || p), '|'), '') END AS line,
 coalesce(array_to_string(CASE WHEN pos % 3 = 0 THEN list_prepend('0', preds) ELSE preds END, '|'), '') AS cube FROM defs""")
def predecessor_list(spark, sf):
    d = definitions(spark, sf)
    text = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("0, ,"), F.array_join("predecessors", ",  "))).otherwise(
        F.concat(F.lit(" "), F.array_join("predecessors", ", ")))
    return d.select("pos", F.array_join(s.predecessor_list(text), "|").alias("line"), F.array_join(s.predecessor_list(text, cube=True), "|").alias("cube"))


@query("positive_int_id", """SELECT event_id, user_id % 4 = 0 AND user_id > 0 AS ok FROM events""")
def positive_int_id(spark, sf):
    u = F.col("user_id")
    text = F.concat(F.when(u % 4 == 1, "0").when(u % 4 == 2, "-").when(u % 4 == 3, "t").otherwise(""), u.cast("string"))
    return table(spark, sf, "events").select("event_id", s.positive_int_id(text).alias("ok"))


@query("render_params", """SELECT id, CASE WHEN p_seg IS NULL THEN '' ELSE 'pSegment="' || p_seg || '" pPeriod="' || p_per || '" pMode="full"' END AS inline,
 CASE WHEN p_seg IS NULL THEN 'k="v"' ELSE 'pSegment="' || p_seg || '" pPeriod="' || p_per || '" pMode="full"; k="v"' END AS sets FROM ex""")
def render_params(spark, sf):
    one = F.create_map(F.lit("k"), F.lit("v"))
    return executions(spark, sf).select("id", s.render_params("parameters").alias("inline"),
                                        s.render_param_sets(F.array("parameters", one)).alias("sets"))


@query("format_duration", """SELECT event_id, CASE WHEN d >= 60 THEN floor(d / 60)::BIGINT || 'm ' || round_even(d % 60, 0)::BIGINT || 's' ELSE printf('%.1f', d) || 's' END AS label
 FROM (SELECT event_id, CAST(round(value * 60, 0) AS DOUBLE) + 0.25 AS d FROM events)""".replace("+ 0.25", "+ 0.2"))
def format_duration(spark, sf):
    d = F.round(F.col("value") * 60, 0) + 0.2
    return table(spark, sf, "events").select("event_id", s.format_duration(d).alias("label"))


@query("round_to_5", "SELECT event_id, greatest(5, round_even(value / 5.0, 0) * 5)::INTEGER AS workers FROM events")
def round_to_5(spark, sf):
    return table(spark, sf, "events").select("event_id", s.round_to_5("value").alias("workers"))


@query("safe_name", """SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{N}_-]', '_', 'g') AS name FROM pages""")
def safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", s.safe_name("url").alias("name"))


@query("session_context", """SELECT page_id, substr('Session' || CASE WHEN page_id % 2 = 0 THEN 'X' ELSE '' END || '_' || url, 1, 64) AS context,
 page_id % 2 = 0 AS exclusive, substr(url, 1, 64 - CASE WHEN page_id % 2 = 0 THEN 9 ELSE 8 END) AS workflow FROM pages""")
def session_context(spark, sf):
    p = table(spark, sf, "pages").withColumn("context", s.session_context("url", F.col("page_id") % 2 == 0))
    return p.select("page_id", "context", s.parse_session_context("context").alias("c")).select("page_id", "context", "c.*")


LINE_OPT = """CASE WHEN safe_retry THEN ' safe_retry="True"' ELSE '' END || ' stage="' || stage || '"'"""
LINE_PROC = """CASE WHEN timeout IS NOT NULL THEN ' timeout="' || timeout || '"' ELSE '' END || CASE WHEN cancel_at_timeout THEN ' cancel_at_timeout="True"' ELSE '' END"""
PY = "CASE WHEN {} THEN 'True' ELSE 'False' END"


@query("task_line", f"""SELECT pos, CASE WHEN chore IS NOT NULL THEN 'instance="' || instance || '" chore="' || chore || '"' || {LINE_OPT}
 ELSE 'instance="' || instance || '" process="' || process || '" succeed_on_minor_errors="' || {PY.format('succeed_on_minor_errors')} || '"' || {LINE_OPT} || {LINE_PROC} || ' pSegment="' || p_seg || '" pPeriod="' || p_per || '"' END AS line,
 'id="' || id || '" predecessors="' || array_to_string(preds, ',') || '" require_predecessor_success="' || {PY.format('require_predecessor_success')} || '"' ||
 CASE WHEN chore IS NOT NULL THEN {LINE_OPT} || ' instance="' || instance || '" chore="' || chore || '"'
 ELSE ' succeed_on_minor_errors="' || {PY.format('succeed_on_minor_errors')} || '"' || {LINE_OPT} || {LINE_PROC} || ' instance="' || instance || '" process="' || process || '" pSegment="' || p_seg || '" pPeriod="' || p_per || '"' END AS graph_line FROM defs""")
def task_line(spark, sf):
    return definitions(spark, sf).select("pos", s.task_line().alias("line"), s.task_line(True).alias("graph_line"))


@query("fan_out_key", """SELECT id, coalesce(p_per, '') || '|' || coalesce(p_seg, '') AS fan_out FROM ex""")
def fan_out_key(spark, sf):
    keys = F.array(F.lit("pSegment"), F.lit("pPeriod"))
    return executions(spark, sf).select("id", s.fan_out_key("parameters", keys).alias("fan_out"))


@query("short_label", """SELECT page_id, CASE WHEN length(url) > 40 THEN substr(url, 1, 37) || '...' ELSE url END AS long_label, CASE WHEN length(url) > 16 THEN substr(url, 1, 16) || '...' ELSE url END AS label FROM pages""")
def short_label(spark, sf):
    return table(spark, sf, "pages").select("page_id", s.short_label("url", 40, 37).alias("long_label"), s.short_label("url", 16, 16).alias("label"))
