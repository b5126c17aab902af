"""Alert queries: candidates, fields, routing, queues, escalation, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.functions import rules
from alertflow.operators import alerts, scoring
from alertflow.plans.registry import Plans
from alertflow.plans.scoring import HEURISTIC, heuristic
from alertflow.plans.tables import LOGS, logs, sql

plans = Plans()

ALERTS = """candidates AS (SELECT *, CASE WHEN anomaly_score >= 0.9::DOUBLE THEN 'CRITICAL' WHEN anomaly_score >= 0.7::DOUBLE THEN 'HIGH'
  WHEN anomaly_score >= 0.5::DOUBLE THEN 'MEDIUM' WHEN anomaly_score >= 0.3::DOUBLE THEN 'LOW' ELSE 'INFO' END AS severity
  FROM heuristic WHERE anomaly_score > 0.1::DOUBLE),
alerts AS (SELECT 'ALERT-' || upper(substr(sha256(id), 1, 16)) AS alert_id,
  coalesce(trace_id, 'COR-' || substr(sha256(id), 1, 16)) AS correlation_id, id AS source_log_id,
  service_name, hostname, pod_name, severity, 'OPEN' AS status, level,
  severity || ' Alert: ' || coalesce(anomaly_type, 'null') || ' anomaly detected in ' || service_name AS title,
  'Anomaly detected with score: ' || anomaly_score || chr(10) || 'Service: ' || service_name || chr(10)
    || 'Host: ' || hostname || chr(10) || 'Log Level: ' || level || chr(10) || 'Message: ' || message || chr(10)
    || CASE WHEN len(anomaly_reasons) > 0 THEN 'Reasons: ' || array_to_string(anomaly_reasons, ', ') ELSE '' END AS description,
  anomaly_score, anomaly_reasons, anomaly_type, event_ts AS created_at, event_id,
  base64(unhex(md5(service_name || hostname || coalesce(anomaly_type, 'null') || level))) AS fingerprint,
  CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'alerts.critical' ELSE 'alerts.info' END AS topic
  FROM candidates)"""
BASE = (LOGS, HEURISTIC, ALERTS)


def build(spark, d, wide=False):
    return alerts.build_alerts(alerts.alert_candidates(heuristic(spark, d, wide)))


@plans.add("alerts_by_service_severity_topic", sql(LOGS, """s AS (SELECT service_name,
  CASE WHEN level IN ('ERROR', 'FATAL') THEN 0.7::DOUBLE WHEN level = 'WARN' THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END AS x,
  hostname || level AS f FROM logs)""", """SELECT service_name, CASE WHEN x >= 0.7::DOUBLE THEN 'HIGH' ELSE 'LOW' END AS severity,
  CASE WHEN x >= 0.7::DOUBLE THEN 'alerts.critical' ELSE 'alerts.info' END AS topic, count(*) AS alerts,
  count(DISTINCT f) AS fingerprints FROM s WHERE x > 0.1::DOUBLE GROUP BY ALL"""))
def _(spark, d):
    found = alerts.build_alerts(alerts.alert_candidates(scoring.score_default(logs(spark, d))))
    return (
        alerts.route_topic(found)
        .groupBy("service_name", "severity", "topic")
        .agg(F.count("*").alias("alerts"), F.countDistinct("fingerprint").alias("fingerprints"))
    )


@plans.add("alert_candidates", sql(*BASE, "SELECT source_log_id AS id, anomaly_score FROM alerts"))
def _(spark, d):
    return alerts.alert_candidates(heuristic(spark, d)).select("id", "anomaly_score")


@plans.add("alert_severity", sql(*BASE, "SELECT alert_id, severity FROM alerts"))
def _(spark, d):
    return build(spark, d).select("alert_id", "severity")


@plans.add("alert_severity_thresholds", sql(LOGS, HEURISTIC, """SELECT id, CASE WHEN anomaly_score >= 1::DOUBLE THEN 'CRITICAL'
  WHEN anomaly_score >= 0.8::DOUBLE THEN 'HIGH' WHEN anomaly_score >= 0.4::DOUBLE THEN 'MEDIUM'
  WHEN anomaly_score >= 0.2::DOUBLE THEN 'LOW' ELSE 'INFO' END AS severity FROM heuristic"""))
def _(spark, d):
    bounds = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.4, "LOW": 0.2}
    return heuristic(spark, d).select("id", rules.severity(F.col("anomaly_score"), bounds).alias("severity"))


@plans.add("alert_title", sql(*BASE, "SELECT alert_id, title FROM alerts"))
def _(spark, d):
    return build(spark, d).select("alert_id", "title")


@plans.add("alert_description", sql(*BASE, "SELECT alert_id, description FROM alerts"))
def _(spark, d):
    return build(spark, d).select("alert_id", "description")


@plans.add("alert_fingerprint", sql(*BASE, "SELECT alert_id, fingerprint FROM alerts"))
def _(spark, d):
    return build(spark, d).select("alert_id", "fingerprint")


@plans.add("alert_ids", sql(*BASE, "SELECT alert_id, correlation_id, source_log_id FROM alerts"))
def _(spark, d):
    return build(spark, d).select("alert_id", "correlation_id", "source_log_id")


@plans.add("alert_metadata", sql(LOGS, HEURISTIC, """c AS (SELECT * FROM heuristic WHERE anomaly_score > 0.1::DOUBLE),
  m AS (SELECT 'ALERT-' || upper(substr(sha256(id), 1, 16)) AS alert_id, unnest(['featureScores', 'k', 'originalTimestamp', 'scoredAt', 'spanId', 'traceId']) AS key,
  unnest(['{}', k::VARCHAR, strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f'), strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f'), NULL, trace_id]) AS value FROM c)""",
  "SELECT * FROM m"))
def _(spark, d):
    return build(spark, d).select("alert_id", F.explode("metadata").alias("key", "value"))


@plans.add("alert_tags", sql(LOGS, HEURISTIC, """c AS (SELECT * FROM heuristic WHERE anomaly_score > 0.1::DOUBLE)""",
  """SELECT 'ALERT-' || upper(substr(sha256(id), 1, 16)) AS alert_id, 'service:' || service_name || ',level:' || lower(level) || ',anomaly_type:'
  || coalesce(anomaly_type, 'null') || ',host:' || hostname AS tags FROM c"""))
def _(spark, d):
    return build(spark, d).select("alert_id", F.array_join("tags", ",").alias("tags"))


@plans.add("build_alerts", sql(*BASE, """SELECT alert_id, correlation_id, source_log_id, service_name, hostname, pod_name, severity,
  status, title, anomaly_score, anomaly_type, created_at, created_at AS updated_at, 0::INTEGER AS escalation_level,
  true AS suppress_duplicates, fingerprint FROM alerts"""))
def _(spark, d):
    return build(spark, d).select(
        "alert_id", "correlation_id", "source_log_id", "service_name", "hostname", "pod_name", "severity", "status",
        "title", "anomaly_score", "anomaly_type", "created_at", "updated_at", "escalation_level",
        "suppress_duplicates", "fingerprint",
    )


@plans.add("route_topic", sql(*BASE, "SELECT alert_id, topic FROM alerts"))
def _(spark, d):
    return alerts.route_topic(build(spark, d)).select("alert_id", "topic")


QUEUES = """queued AS (SELECT a.*, q.queue, q.ttl, q.queue = 'auto-actions' AS action_required, q.queue = 'critical-alerts' AS urgent
  FROM alerts a JOIN (VALUES ('notifications', 3600), ('auto-actions', 1800), ('critical-alerts', 7200)) q(queue, ttl)
  ON q.queue = 'notifications' OR (q.queue = 'auto-actions' AND severity IN ('CRITICAL', 'HIGH'))
  OR (q.queue = 'critical-alerts' AND severity = 'CRITICAL'))"""


@plans.add("fan_out_queues", sql(*BASE, QUEUES, """SELECT alert_id, severity, service_name, queue, action_required, urgent,
  created_at + to_seconds(ttl) AS expires_at FROM queued"""))
def _(spark, d):
    return alerts.fan_out(build(spark, d)).select(
        "alert_id", "severity", "service_name", "queue", "action_required", "urgent", "expires_at"
    )


@plans.add("live_deliveries", sql(*BASE, QUEUES, """SELECT alert_id, queue FROM queued WHERE created_at <= TIMESTAMP '2024-01-20 12:00:00'
  AND created_at + to_seconds(ttl) > TIMESTAMP '2024-01-20 12:00:00'"""))
def _(spark, d):
    as_of = F.to_timestamp_ntz(F.lit("2024-01-20 12:00:00"))
    return alerts.live_deliveries(alerts.fan_out(build(spark, d)), as_of).select("alert_id", "queue")


@plans.add("alert_stats_cube", sql(*BASE, """SELECT service_name, severity, topic, grouping(service_name, severity, topic)::INTEGER AS grouping_level,
  count(*) AS alerts, round(avg(anomaly_score), 6) AS average_score FROM alerts GROUP BY CUBE (service_name, severity, topic)"""))
def _(spark, d):
    return alerts.alert_stats(build(spark, d)).withColumn("average_score", F.round("average_score", 6))
