"""The corpus operators as queries over the synthetic tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import fingerprint, html_text, line_dedup, mixing, ngram_join, packing, shards, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved_pages(table(spark, sf_dir, "pages"))


def op3_invertible_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.render_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), F.col("_lines.total").alias("n_lines"), F.col("_lines.kept").alias("kept_lines"), F.col("_lines.text").alias("text"))


def op2_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), 3, 9, 10).drop("h")


def op7_byte_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), 40)


def op8_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_revisit_resolution, op2_norm_bucketed_topk, op3_invertible_fingerprints, op4_pu_toxicity, op5_layout_text,
        op6_ngram_jaccard_join, op7_byte_balanced_shards, op8_sainte_lague_mixing, op9_fuzzy_line_dedup, op10_best_fit_packing,
    )
}

_CANONICAL = """
    host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END"""

ORACLES: dict[str, str] = {
    "op1_revisit_resolution": r"""
        WITH b AS (SELECT CAST(page_id AS BIGINT) AS p, url, '"' || md5(coalesce(html, '')) || '"' AS tag, md5(coalesce(html, '')) AS digest FROM pages WHERE page_id IS NOT NULL),
        log AS (
            SELECT 4 * p AS record_id, url, 10 * p AS ts, true AS is_full, tag AS etag, 't' || p AS last_modified, 't' || 10 * p AS date, NULL AS expires, digest FROM b
            UNION ALL SELECT 4 * p + 1, url || '#part', 10 * p + 5, false, CASE WHEN p % 5 = 0 THEN NULL WHEN p % 3 = 0 THEN '"other"' ELSE tag END, NULL, 't' || (10 * p + 5), CASE WHEN p % 5 = 0 THEN NULL ELSE 't' || (10 * p + 105) END, digest FROM b
            UNION ALL SELECT 4 * p + 2, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=a', 10 * p + 50001, false, CASE WHEN p % 5 = 0 THEN NULL WHEN p % 3 = 0 THEN '"other"' ELSE tag END, NULL, 't' || (10 * p + 50001), CASE WHEN p % 5 = 0 THEN NULL ELSE 't' || (10 * p + 50101) END, digest FROM b
            UNION ALL SELECT 4 * p + 3, url, 10 * p - 3, false, CASE WHEN p % 5 = 0 THEN NULL WHEN p % 3 = 0 THEN '"other"' ELSE tag END, NULL, 't' || (10 * p - 3), CASE WHEN p % 5 = 0 THEN NULL ELSE 't' || (10 * p + 97) END, digest FROM b),
        bare AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM log),
        cut AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^(.*@)?(www\.)?', ''), ':(80|443)$', '') AS host,
                       regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
                       list_sort([x FOR x IN string_split(regexp_extract(u, '\?(.*)$', 1), '&') IF x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)')]) AS kept FROM bare),
        named AS (SELECT *, CASE WHEN url IS NOT NULL THEN CANONICAL END AS key FROM cut),
        best AS (SELECT v.record_id, max(CASE WHEN f.record_id IS NOT NULL THEN {'ts': f.ts, 'id': f.record_id} END) AS f
                 FROM named v LEFT JOIN named f ON f.is_full AND f.key = v.key AND f.ts < v.ts WHERE NOT v.is_full GROUP BY v.record_id),
        met AS (SELECT v.*, b.f.id AS refers_to, s.etag AS s_etag, s.last_modified AS s_modified, s.digest AS s_digest,
                       CASE WHEN b.f.id IS NULL THEN 'missing' WHEN v.etag IS NOT NULL THEN CASE WHEN v.etag = s.etag THEN 'resolved' ELSE 'mismatch' END
                            WHEN v.digest = s.digest THEN 'resolved' ELSE 'mismatch' END AS outcome
                FROM named v JOIN best b ON b.record_id = v.record_id LEFT JOIN named s ON s.record_id = b.f.id)
        SELECT record_id, key, ts, refers_to, outcome,
               CASE WHEN outcome = 'resolved' THEN CASE WHEN etag IS NULL THEN s_etag ELSE 'W/' || etag END END AS etag,
               CASE WHEN outcome = 'resolved' THEN s_modified END AS last_modified, CASE WHEN outcome = 'resolved' THEN date END AS date,
               CASE WHEN outcome = 'resolved' THEN 'text/html' END AS content_type, CASE WHEN outcome = 'resolved' THEN 'max-age=60' END AS cache_control,
               CASE WHEN outcome = 'resolved' THEN expires END AS expires, CAST(NULL AS VARCHAR) AS content_length
        FROM met""".replace("CANONICAL", _CANONICAL),
    "op2_norm_bucketed_topk": """
        WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id,
                          CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
}
