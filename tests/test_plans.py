"""Shapes of physical plans that matter on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from alertflow.operators import alerts, dashboards, features, incident_queries, outbox, scoring
from alertflow.plans import tables
from alertflow.sources import intake


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tiny, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "alerts")
    scored = scoring.score_heuristic(tables.logs(spark, tiny))
    alerts.build_alerts(alerts.alert_candidates(scored)).write.parquet(path)
    return path


def test_row_work_does_not_shuffle(spark, tiny):
    logs = tables.logs(spark, tiny)
    scored = scoring.score_heuristic(logs).withColumn("reasons", scoring.anomaly_reasons())
    built = alerts.fan_out(alerts.route_topic(alerts.build_alerts(alerts.alert_candidates(scored))))
    assert "Exchange" not in plan(outbox.fan_out_channels(built))


def test_filters_and_columns_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    table = spark.read.parquet(stored)
    p = plan(incident_queries.by_fields(table, service_name="auth-service", status="OPEN").select("alert_id"))
    assert "EqualTo(service_name,auth-service)" in p and "EqualTo(status,OPEN)" in p
    assert re.search(r"ReadSchema: struct<alert_id:string,service_name:string,status:string>", p)
    p = plan(dashboards.time_series(table, F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00"))))
    assert "GreaterThanOrEqual(created_at" in p and "ReadSchema: struct<created_at:timestamp_ntz>" in p


def test_top_k_is_cut_before_the_shuffle(spark, stored):
    table = spark.read.parquet(stored)
    assert "TakeOrderedAndProject" in plan(dashboards.recent_alerts(table))
    assert plan(dashboards.newest_per_service(table)).count("WindowGroupLimit") == 2


def test_terms_are_counted_in_their_row_and_dealt_by_id_without_text(spark, monkeypatch):
    """One row a distinct term is joined, by hash where the vocabulary is large; rows dealt by id carry no term."""
    docs = [(1, "tea tea tea milk"), (2, "tea milk milk"), (3, ""), (4, None), (4, "milk sugar"), (None, "tea sugar"), (None, "tea")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    terms = sorted(tuple(r) for r in features.counted_terms(table.filter("doc_id < 3"), "text").collect())
    assert terms == [
        (1, "milk", 1), (1, "tea", 3), (1, "tea milk", 1), (1, "tea tea", 2),
        (2, "milk", 2), (2, "milk milk", 1), (2, "tea", 1), (2, "tea milk", 1),
    ]
    monkeypatch.setattr(features, "LOOKED_UP", 1)
    vocabulary = features.fit_vocabulary(table, "doc_id", "text", max_df=1.0)
    assert sorted((r.term, r.idx, r.df) for r in vocabulary.collect()) == [("milk", 0, 3), ("sugar", 1, 2), ("tea", 2, 4), ("tea milk", 3, 2)]
    got = features.tfidf(table, vocabulary, "doc_id", "text")
    assert got.groupBy("doc_id", "term").count().filter("count > 1").isEmpty()  # rows of one id are one text
    assert got.filter("doc_id is null").count() == 2 and got.filter("doc_id = 4").count() == 2
    once = features.tfidf(table.filter("doc_id < 3"), vocabulary, "doc_id", "text").groupBy("doc_id").agg(F.sum("weight"))
    p = plan(once)
    assert "ShuffledHashJoin" in p and "SortMergeJoin" not in p
    assert not re.search(r"hashpartitioning\(doc_id[^\n]*\n[^\n]*term#", p) and len(re.findall(r"hashpartitioning\(doc_id", p)) == 1


def test_json_is_parsed_once(spark):
    raw = spark.createDataFrame([("{}",)], "value string")
    good, _ = intake.split_malformed(intake.ingest_logs(raw))
    assert plan(good).count("from_json(") == 1


def test_counters_use_one_scan(spark, stored):
    assert plan(dashboards.counters(spark.read.parquet(stored))).count("FileScan") == 1
