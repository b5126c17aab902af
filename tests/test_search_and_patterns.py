"""Posting tables, pattern tables and settings that change while a stream runs."""

import datetime as dt
import re

from pyspark.sql import functions as F

from alertflow.operators import incident_queries as iq
from alertflow.operators import postings, responder, scoring
from alertflow.plans import tables
from alertflow.streaming import flow

QUERIES = (
    "timeout", "Timeout disk", '"connection timed out"', '"time"', '"ion timed"', '"disk full" -order', "full -disk", '"out of memory" "service a"',
    "-disk", "", '"..."', '"a: d"', "naïve", "x_y",
)
AT = dt.datetime(2024, 1, 1)


def incident(n, title, description, reasons=(), version=0):
    return (f"a{n}", title, description, list(reasons), AT + dt.timedelta(hours=n), AT + dt.timedelta(hours=n, minutes=version))


SCHEMA = "alert_id string, title string, description string, anomaly_reasons array<string>, created_at timestamp_ntz, updated_at timestamp_ntz"
FIRST = [
    incident(1, "Service A: disk full", "connection timed out"), incident(2, "Order timeout", None, ["Disk full", "naïve x_y"]),
    incident(3, None, None), incident(4, "", ""), incident(5, "Out of memory in service a", "order disk full ..."),
    incident(6, "timeout", "reconnection timed outside"),
]
SECOND = [incident(1, "Service A: repaired", "all well", version=5), incident(7, "disk", "timeout of order"), incident(4, "disk full", "x", version=1)]


def test_postings_follow_the_incidents(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    rows = spark.createDataFrame(FIRST, SCHEMA)
    now = {}
    for part in (FIRST, SECOND):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(at("in"))
        q = flow.start_postings(spark.readStream.schema(rows.schema).parquet(at("in")), at("index"), at("chk"))
        assert q.awaitTermination(120) and q.exception() is None
        now |= {r[0]: r for r in part}
        current = spark.createDataFrame(list(now.values()), SCHEMA).cache()
        index = postings.Postings(spark, at("index"))
        for query in QUERIES:
            want = {r.alert_id for r in iq.text_search(current, query).collect()}
            got = [r.alert_id for r in postings.search(current, index, query).collect()]
            assert len(got) == len(set(got)) and set(got) == want, query
    plan = index.having(["timeout"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)


def test_ten_thousand_patterns(spark):
    names = [f"svc{i}-service" for i in range(300)] + ["order-service", "order-service-eu", "a.b", "", None, "Ünit-1"]
    patterns = [f"svc{i}-serv.*" for i in range(0, 20_000, 2)] + ["order-servic+e.*", "or?der.*eu", "a\\.b", "x|Ünit-1", None, "", "(?i)ORDER-service"]
    alerts = spark.createDataFrame([(n,) for n in names], "service_name string")
    table = spark.createDataFrame([(p,) for p in patterns * 2], "pattern string")
    got = {(r.service_name, r.pattern) for r in responder.match_patterns(alerts, table).collect()}
    real = [n for n in names if n is not None]
    want = {(n, f"svc{i}-serv.*") for i, n in enumerate(real[:300]) if i % 2 == 0}
    want |= {(n, p) for n in real[300:] for p in patterns[-7:] if p is not None and re.fullmatch(p, n)}
    assert got == want
    rows = [(str(i), n, "CRITICAL", 0.95) for i, n in enumerate(names)] + [("low", "order-service", "LOW", 0.99)]
    planned = responder.plan_actions_from(spark.createDataFrame(rows, "alert_id string, service_name string, severity string, anomaly_score double"), table)
    assert {r.service_name for r in planned.collect()} == {n for n, _ in want}


def test_threshold_changes_while_the_stream_goes_on(spark, tiny, tmp_path):
    at = lambda n: str(tmp_path / n)
    logs = tables.logs(spark, tiny)
    parts = logs.randomSplit([0.5, 0.5], 3)
    setting = lambda v: spark.createDataFrame([("anomaly_threshold", v), ("other", 9.0)], "name string, value double").write.mode("overwrite").parquet(at("set"))
    parts[0].coalesce(1).write.parquet(at("in"))
    setting(0.1)
    q = flow.start_scoring(spark.readStream.schema(logs.schema).parquet(at("in")), at("set"), at("out"), at("chk"), {"processingTime": "1 second"})
    try:
        q.processAllAvailable()
        setting(0.65)
        parts[1].coalesce(1).write.mode("append").parquet(at("in"))
        q.processAllAvailable()
    finally:
        q.stop()
    out = spark.read.parquet(at("out"))
    for part, limit in zip(parts, (0.1, 0.65), strict=True):
        ids = part.select("id")
        got = {(r.id, r.is_anomaly, r.threshold_used) for r in out.join(ids, "id").collect()}
        want = {(r.id, r.is_anomaly, r.threshold_used) for r in scoring.score_heuristic(part, limit).collect()}
        assert got == want and {t for _, _, t in got} == {limit}
    assert out.select("threshold_used").distinct().count() == 2 and out.count() == logs.count()
    assert {r[0] for r in out.filter(F.col("threshold_used") == 0.1).select("batch").distinct().collect()} == {0}
