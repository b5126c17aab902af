"""Alert versions derived from the alert table, and the incidents they fold into."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.operators import incidents
from alertflow.plans.alerting import BASE, build


def versions(spark, d):
    """Status, severity and assignee history of every alert; one to six versions, made row by row."""
    a = build(spark, d, wide=True)
    n = F.substring("source_log_id", 5, 20).cast("bigint")

    def step(no, minutes, status, wanted, severity=None, assignee=None):
        return F.when(
            wanted,
            F.struct(
                F.lit(no).cast("bigint").alias("no"),
                F.lit(minutes).alias("minutes"),
                F.lit(status).alias("status"),
                F.lit(severity).cast("string").alias("severity"),
                (assignee if assignee is not None else F.lit(None)).cast("string").alias("assignee"),
            ),
        )

    who = lambda shift: F.concat(F.lit("user-"), ((n + shift) % 5).cast("string"))
    steps = F.filter(
        F.array(
            step(0, 0, "OPEN", F.lit(True)),
            step(1, 10, "ACKNOWLEDGED", n % 2 == 0, None, who(0)),
            step(2, 20, "OPEN", n % 5 == 0, "CRITICAL", None),
            step(3, 30, "INVESTIGATING", n % 3 == 0, None, who(1)),
            step(4, 60, "RESOLVED", n % 4 == 0, None, who(0)),
            step(5, 1440, "CLOSED", n % 8 == 0, None, who(0)),
        ),
        lambda s: s.isNotNull(),
    )
    v = a.withColumn("_s", F.explode(steps))
    raised = F.when((F.col("_s.no") >= 2) & (n % 5 == 0), F.lit("CRITICAL")).otherwise(F.col("severity"))
    return v.withColumns(
        {
            "status": F.col("_s.status"),
            "severity": raised,
            "assignee": F.col("_s.assignee"),
            "version_no": F.col("_s.no"),
            "version_ts": F.timestamp_add("MINUTE", F.col("_s.minutes"), F.col("created_at")),
        }
    ).drop("_s")


def folded(spark, d):
    return incidents.fold_incidents(versions(spark, d))


VERSIONS = """versions AS (SELECT a.* EXCLUDE (status, severity), v.no AS version_no, a.created_at + to_minutes(v.minutes) AS version_ts, v.status,
  CASE WHEN v.no >= 2 AND event_id % 5 = 0 THEN 'CRITICAL' ELSE a.severity END AS severity,
  CASE WHEN v.no IN (1, 4, 5) THEN 'user-' || (event_id % 5) WHEN v.no = 3 THEN 'user-' || ((event_id + 1) % 5) END AS assignee
  FROM alerts a JOIN (VALUES (0, 0, 'OPEN', 1), (1, 10, 'ACKNOWLEDGED', 2), (2, 20, 'OPEN', 5), (3, 30, 'INVESTIGATING', 3),
    (4, 60, 'RESOLVED', 4), (5, 1440, 'CLOSED', 8)) v(no, minutes, status, modulus) ON event_id % v.modulus = 0),
seen AS (SELECT *, lag(status) OVER w AS old_status, lag(severity) OVER w AS old_severity,
  last_value(assignee IGNORE NULLS) OVER (PARTITION BY alert_id ORDER BY version_ts, version_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_assignee,
  row_number() OVER w = 1 AS is_first FROM versions WINDOW w AS (PARTITION BY alert_id ORDER BY version_ts, version_no)),
changes AS (SELECT *, NOT is_first AND status <> old_status AS st, NOT is_first AND severity <> old_severity AS sv,
  NOT is_first AND assignee IS NOT NULL AND assignee IS DISTINCT FROM old_assignee AS ag FROM seen)"""
EVENTS = """log AS (
  SELECT alert_id, version_ts AS event_time, version_no, 0 AS ord, 'CREATED' AS event_type, 'Incident created from alert' AS description FROM changes WHERE is_first
  UNION ALL SELECT alert_id, version_ts, version_no, 1, CASE WHEN status IN ('ACKNOWLEDGED', 'INVESTIGATING', 'RESOLVED', 'CLOSED') THEN status ELSE 'CREATED' END,
    'Status changed from ' || old_status || ' to ' || status FROM changes WHERE st
  UNION ALL SELECT alert_id, version_ts, version_no, 2, 'ESCALATED', 'Severity changed to ' || severity FROM changes WHERE sv
  UNION ALL SELECT alert_id, version_ts, version_no, 3, 'ASSIGNED', 'Assigned to ' || assignee FROM changes WHERE ag)"""
FOLDED = """incidents AS (SELECT c.alert_id, any_value(correlation_id) AS correlation_id, any_value(source_log_id) AS source_log_id,
  any_value(service_name) AS service_name, any_value(hostname) AS hostname, any_value(title) AS title, any_value(description) AS description,
  any_value(anomaly_score) AS anomaly_score, any_value(anomaly_type) AS anomaly_type, any_value(anomaly_reasons) AS anomaly_reasons,
  any_value(created_at) AS created_at, any_value(event_id) AS event_id,
  arg_max(status, version_no) AS status, arg_max(severity, version_no) AS severity,
  arg_max(assignee, version_no) FILTER (assignee IS NOT NULL) AS assignee,
  coalesce(max(version_ts) FILTER (st OR sv OR ag), any_value(created_at)) AS updated_at,
  min(version_ts) FILTER (st AND status = 'RESOLVED') AS resolved_at,
  date_diff('millisecond', any_value(created_at), min(version_ts) FILTER (st AND status = 'ACKNOWLEDGED')) AS time_to_acknowledge,
  date_diff('millisecond', any_value(created_at), min(version_ts) FILTER (st AND status = 'RESOLVED')) AS time_to_resolve,
  (count(*) FILTER (sv))::INTEGER AS escalation_count,
  (count(*) FILTER (st AND old_status IN ('RESOLVED', 'CLOSED') AND status IN ('OPEN', 'ACKNOWLEDGED', 'INVESTIGATING')))::INTEGER AS reopen_count,
  least(CASE arg_min(severity, version_no) WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 25 ELSE 10 END
    + trunc(any_value(anomaly_score) * 50)::INTEGER, 200)::INTEGER AS impact_score,
  any_value(created_at) + INTERVAL 90 DAY AS expires_at
  FROM changes c GROUP BY c.alert_id)"""
LIFE = (*BASE, VERSIONS)
INCIDENTS = (*BASE, VERSIONS, FOLDED)
