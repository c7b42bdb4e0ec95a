"""Queries over the training-data tables, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.site_style_tree import page_texts

    return page_texts(_table(spark, sf_dir, "pages"))


def op2_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.pii import span_report

    return span_report(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.signature_tree import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.crf_language import language_report

    return language_report(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.secret_scan import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.projection_forest import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.pairwise_quality import quality_report

    return quality_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.suffix_decontamination import contamination_report

    return contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.compression_toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_site_style_tree,
        op2_pii_sanitisation,
        op3_ngram_jaccard,
        op4_language_crf,
        op5_secret_scan,
        op6_projection_forest,
        op7_pairwise_quality,
        op8_best_fit_packing,
        op9_decontamination,
        op10_compression_toxicity,
    )
}

#: Words as the contract has them; windows of ten words; a text of fewer is one window.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), q AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM q),
x AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM d, ks, unnest(generate_series(1, len(w) - k + 1)) AS t(i) WHERE len(w) >= k
), m AS (SELECT x.doc_id, x.i, x.k, q.item FROM x JOIN q USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM m, unnest(generate_series(i, i + k - 1)) AS t(p) GROUP BY 1),
its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS l FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(its.l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(its.l, ','), '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

#: All pairs of documents that share a shingle, then labels spread along links until they settle.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
  FROM d, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (g) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(na.n) + any_value(nb.n) - count(*))
), r(x, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x
)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLE_SQL = {"op3_ngram_jaccard": OP3_SQL, "op9_decontamination": OP9_SQL}
