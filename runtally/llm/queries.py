"""The numbered queries of this subpackage over the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from runtally.llm import (alignment, embedding_pairs, factorisation, hard_negatives, imatch, language, line_winnow, minhash, packing, piece_bpe,
                          secret_scan, suffix_dedup, warc)
from runtally.llm.rows import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and its SQL."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op10_piece_bpe")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return piece_bpe.digests(table(spark, sf, "documents"))


@query("op9_zstd_language")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(table(spark, sf, "documents"))


@query("op6_island_packing")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query("op7_hyperminhash", r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
    ), s AS (
      SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
    ), e AS (
      SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
    ), l AS (
      SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
    ), reach(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a)
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(m, s.doc_id)) AS kept
    FROM s LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = s.doc_id""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), percent=85)


@query("op4_projection_collisions", """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    ), ok AS (
      SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0
        AND len([x FOR x IN e IF x <> 0]) > 0
    ), pair AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98
    ), reach(a, b) AS (SELECT a, b FROM pair UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a)
    SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(c.m, v.vec_id)) AS component_id,
      v.vec_id = least(v.vec_id, coalesce(c.m, v.vec_id)) AS kept
    FROM v LEFT JOIN (SELECT a, count(*) AS n FROM pair GROUP BY a) n ON n.a = v.vec_id
      LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) c ON c.a = v.vec_id""")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_pairs.near_vectors(table(spark, sf, "embeddings"))


@query("op3_randomness_battery")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf, "documents"))


@query("op2_factorisation_machine")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return factorisation.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op1_imatch")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return imatch.compare_edited(table(spark, sf, "documents"))


@query("op8_line_winnowing", """
    WITH line AS (
      SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)
    ), weight AS (
      SELECT *, length(line) - length(replace(line, ' ', '')) + 1 AS u FROM line
    ), summed AS (
      SELECT *, sum(u) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS e, (sum(u) OVER (PARTITION BY doc_id ORDER BY pos) - u)::BIGINT AS b FROM weight
    ), win AS (
      SELECT doc_id, pos AS i, max(pos) OVER a AS j, md5(array_to_string(list(line) OVER a, chr(10))) AS w, sum(u) OVER a AS n FROM summed
        WINDOW a AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
      UNION ALL
      SELECT doc_id, min(pos) OVER z AS i, pos AS j, md5(array_to_string(list(line) OVER z, chr(10))) AS w, sum(u) OVER z AS n FROM summed
        WINDOW z AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
    ), won AS (
      SELECT DISTINCT doc_id, i, j, w FROM win WHERE n >= 50
    ), firsts AS (
      SELECT w, arg_min(doc_id, (doc_id, i)) AS d, arg_min(i, (doc_id, i)) AS i0, arg_min(j, (doc_id, i)) AS j0 FROM won GROUP BY w
    ), gone AS (
      SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS pos FROM won JOIN firsts USING (w) WHERE doc_id <> d OR i > j0
    ), left_over AS (
      SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS t
      FROM line l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id
    )
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(length(t), 0) AS n_chars_left, sha256(t) AS left_sha256
    FROM documents d LEFT JOIN left_over USING (doc_id)""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return line_winnow.report(table(spark, sf, "documents"))


@query("op5_content_addressed_warc", """
    WITH p AS (
      SELECT page_id, encode(coalesce(html, '')) AS b, unhex(sha1(encode(coalesce(html, ''))))::BIT::VARCHAR AS bits FROM pages
    ), d AS (
      SELECT page_id, octet_length(b) AS payload_bytes, max(page_id) OVER (PARTITION BY b) AS top,
        array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * (substr(bits, 5 * i + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * i + 2, 1) = '1')::INT
          + 4 * (substr(bits, 5 * i + 3, 1) = '1')::INT + 2 * (substr(bits, 5 * i + 4, 1) = '1')::INT + (substr(bits, 5 * i + 5, 1) = '1')::INT, 1) FOR i IN range(32)], '') AS payload_digest FROM p
    )
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> top THEN top END AS refers_to FROM d""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    warc.write_archive(table(spark, sf, "pages"), path)
    return warc.described(warc.read_archive(spark, path))


@query("op11_interval_coalescing")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.report(table(spark, sf, "documents"))


@query("op12_two_stage_suffixes", """
    WITH d AS (
      SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), string AS (
      SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(octet_length(b) - 49)) AS i FROM d)
    ), first AS (
      SELECT s, min(doc_id) AS m FROM string GROUP BY s HAVING count(*) > 1
    ), gone AS (
      SELECT doc_id, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM string JOIN first USING (s) WHERE doc_id > m WINDOW w AS (PARTITION BY doc_id ORDER BY i)
    ), span AS (
      SELECT doc_id, i AS a, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM gone WHERE before IS NULL OR i - before > 50
    ), stop AS (
      SELECT doc_id, i + 50 AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone WHERE after IS NULL OR after - i > 50
    ), start AS (
      SELECT doc_id, a, next, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM span
    ), cut AS (
      SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans, min(a) AS first_a, string_agg(substr(h, 2 * e + 1, 2 * (coalesce(next, octet_length(b)) - e)), '' ORDER BY a) AS kept
      FROM start JOIN stop USING (doc_id, k) JOIN d USING (doc_id) GROUP BY doc_id
    )
    SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(CASE WHEN first_a IS NULL THEN b ELSE unhex(substr(h, 1, 2 * first_a) || kept) END) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf, "documents"))


@query("op13_hyperplane_tree", """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding]::DOUBLE[] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), score AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0
    ), positive AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM score WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positive JOIN score USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
