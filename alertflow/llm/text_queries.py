"""Registered queries on whole texts: decontamination, language, licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertflow.llm import decontam, langid, licenses


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.report(decontam.scan(_documents(spark, sf_dir), benchmark))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit_on_rest(docs))
    held = langid.held_out(F.col("doc_id")).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score", "ambiguous")


#: First lines of what counts as a licence file here.
HEADED = r"(?i)licen[cs]|copyright|spdx|public domain|permission is hereby"


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies in a folder of its source and of its id, by thousands and hundreds.

    One that begins with a licence header is the licence file of its folder; one whose id is divisible by a thousand
    counts for the whole source if it has a header anywhere.
    """
    docs = _documents(spark, sf_dir)
    k, c = F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100) % 10
    folder = F.concat_ws("/", F.col("source"), k.cast("string"), c.cast("string"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    path = F.concat_ws("/", F.when(F.col("doc_id") % 1000 == 0, F.col("source")).otherwise(folder), name)
    first = F.substring_index(F.col("text"), "\n", 1)
    is_file = first.rlike(HEADED) | (F.col("doc_id") % 1000 == 0)
    return licenses.scan_licenses(docs, path, is_file)


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
        FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, win)),
positions AS (SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
    string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN positions USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {
    "op4_decontamination": op4_decontamination,
    "op6_language_id": op6_language_id,
    "op9_license_scan": op9_license_scan,
}
SQL: dict[str, str] = {"op4_decontamination": DECONTAMINATION_SQL}
