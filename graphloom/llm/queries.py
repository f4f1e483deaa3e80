"""The registered queries of the operators, and the SQL that some of them have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import best_fit_packing, decontamination, html_extraction, line_dedup, lm_scoring, oracles, quality_rules, resampling, secret_scan, simhash_neardup, substring_dedup, suffix_dedup, url_filter, vector_codes
from .common import read


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedupe(read(spark, sf_dir, "documents")).drop("n_spans")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedupe(read(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scoring.score(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(read(spark, sf_dir, "embeddings"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.document_outcomes(pages, read(spark, sf_dir, "labels")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), between=resampling.BETWEEN_WORDS_AND_NUMBERS)


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_line_dedup,
        op3_quality_rules,
        op4_best_fit_packing,
        op5_simhash_near_dedup,
        op6_html_extraction,
        op7_benchmark_decontamination,
        op8_secret_scans,
        op9_suffix_array_dedup,
        op10_lm_scoring,
        op11_vector_code_compression,
        op12_url_filters,
        op13_importance_resampling,
    )
}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL | {
    "op1_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda s: {'s': s, 'k': array_to_string(w[s:s + 19], ' ')})) AS v
  FROM d WHERE len(w) >= 20
), gone AS (
  SELECT doc_id, v.s AS s FROM win
  QUALIFY row_number() OVER (PARTITION BY v.k ORDER BY doc_id, v.s) > 1
), cut AS (
  SELECT DISTINCT doc_id, s + i AS j FROM gone, range(20) t(i)
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS line FROM word ANTI JOIN cut USING (doc_id, j) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM cut GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(line, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
