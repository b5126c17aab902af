"""Registered queries on exact and near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertflow.llm import exact, lines, minhash, passages


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(_documents(spark, sf_dir)).drop("text_hash")


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(_documents(spark, sf_dir))


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT *,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
"""

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op10_passage_dedup": op10_passage_dedup,
}
SQL = {"op2_exact_dedup": EXACT_SQL}
