"""Registered queries on token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from alertflow.llm import packing, token_count, token_files


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    return token_files.read_token_files(token_files.write_token_files(_documents(spark, sf_dir), folder), folder)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


QUERIES = {"op3_token_files": op3_token_files, "op5_token_counts": op5_token_counts, "op7_packing": op7_packing}
SQL: dict[str, str] = {}
