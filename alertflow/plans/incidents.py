"""Incident lifecycle and retention queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.operators import alerts, incidents, retention
from alertflow.plans.alerting import BASE, build
from alertflow.plans.lifecycle import EVENTS, INCIDENTS, LIFE, folded, versions
from alertflow.plans.registry import Plans
from alertflow.plans.tables import sql

plans = Plans()
at = lambda text: F.to_timestamp_ntz(F.lit(text))


@plans.add("initial_incidents", sql(*BASE, """SELECT alert_id, service_name AS affected_services, severity, status,
  least(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75 WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 25 ELSE 10 END
    + trunc(anomaly_score * 50)::INTEGER, 200)::INTEGER AS impact_score,
  0::INTEGER AS escalation_count, 0::INTEGER AS notifications_sent, created_at + INTERVAL 90 DAY AS expires_at FROM alerts"""))
def _(spark, d):
    return incidents.initial_incidents(build(spark, d)).select(
        "alert_id", F.array_join("affected_services", ",").alias("affected_services"), "severity", "status",
        "impact_score", "escalation_count", "notifications_sent", "expires_at",
    )


@plans.add("impact_score", sql(*BASE, """SELECT severity, least(CASE severity WHEN 'CRITICAL' THEN 100 WHEN 'HIGH' THEN 75
  WHEN 'MEDIUM' THEN 50 WHEN 'LOW' THEN 25 ELSE 10 END + trunc(anomaly_score * 50)::INTEGER, 200)::INTEGER AS impact_score,
  count(*) AS alerts FROM alerts GROUP BY ALL"""))
def _(spark, d):
    impact = incidents.impact_score(F.col("severity"), F.col("anomaly_score"))
    return build(spark, d).groupBy("severity", impact.alias("impact_score")).agg(F.count("*").alias("alerts"))


FOLD_COLUMNS = (
    "alert_id", "status", "severity", "assignee", "updated_at", "resolved_at", "time_to_resolve", "impact_score",
    "expires_at", "created_at",
)


@plans.add("fold_incidents", sql(*INCIDENTS, f"SELECT {', '.join(FOLD_COLUMNS)} FROM incidents"))
def _(spark, d):
    return folded(spark, d).select(*FOLD_COLUMNS)


@plans.add("upsert_incidents", sql(*INCIDENTS, f"SELECT {', '.join(FOLD_COLUMNS)}, escalation_count FROM incidents"))
def _(spark, d):
    """Two batches: the first versions create the incidents, the later ones update them."""
    v = versions(spark, d)
    state = incidents.fold_incidents(v.filter(F.col("version_no") < 2))
    return incidents.apply_versions(state, v.filter(F.col("version_no") >= 2)).select(*FOLD_COLUMNS, "escalation_count")


def log_where(kind, where):
    """Event rows of one kind, with their texts."""
    plans.add(kind, sql(*LIFE, EVENTS, f"SELECT alert_id, event_time, event_type, description FROM log WHERE {where}"))(
        lambda spark, d: incidents.incident_events(versions(spark, d))
        .filter(where)
        .select("alert_id", "event_time", "event_type", "description")
    )


log_where("status_events", "ord = 1")
log_where("severity_events", "ord = 2")
log_where("assignee_events", "ord = 3")


@plans.add("incident_event_log", sql(*LIFE, EVENTS, """SELECT alert_id, event_time, event_type, description, 'system' AS user_id,
  ord::INTEGER AS ord, version_no::BIGINT AS version_no FROM log"""))
def _(spark, d):
    return incidents.incident_events(versions(spark, d)).drop("event_id")


@plans.add("resolution_times", sql(*INCIDENTS, """SELECT alert_id, resolved_at, time_to_resolve, updated_at FROM incidents
  WHERE resolved_at IS NOT NULL"""))
def _(spark, d):
    return (
        folded(spark, d)
        .filter(F.col("resolved_at").isNotNull())
        .select("alert_id", "resolved_at", "time_to_resolve", "updated_at")
    )


@plans.add("acknowledge_metrics", sql(*INCIDENTS, """SELECT alert_id, time_to_acknowledge, escalation_count, reopen_count
  FROM incidents"""))
def _(spark, d):
    return folded(spark, d).select("alert_id", "time_to_acknowledge", "escalation_count", "reopen_count")


def comments(spark, d):
    """A comment per CRITICAL alert; some blank, some without a user."""
    a = build(spark, d).filter(F.col("severity") == "CRITICAL")
    n = F.substring("source_log_id", 5, 20).cast("bigint")
    return a.select(
        "alert_id",
        F.when(n % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit("looked at "), F.col("source_log_id"))).alias("comment"),
        F.when(n % 2 == 0, F.lit("user-1")).alias("user_id"),
        (F.col("created_at") + F.expr("INTERVAL '5' MINUTE")).alias("commented_at"),
    )


COMMENTS = """comments AS (SELECT alert_id, CASE WHEN event_id % 3 = 0 THEN '   ' ELSE 'looked at ' || source_log_id END AS comment,
  CASE WHEN event_id % 2 = 0 THEN 'user-1' END AS user_id, created_at + INTERVAL 5 MINUTE AS commented_at FROM alerts WHERE severity = 'CRITICAL')"""


@plans.add("comment_events", sql(*LIFE, EVENTS, COMMENTS, """SELECT alert_id, event_time, event_type, description, 'system' AS user_id FROM log
  UNION ALL SELECT alert_id, commented_at, 'COMMENTED', comment, coalesce(user_id, 'anonymous') FROM comments WHERE trim(comment) <> ''"""))
def _(spark, d):
    log = incidents.incident_events(versions(spark, d))
    return incidents.add_comments(log, comments(spark, d)).select(
        "alert_id", "event_time", "event_type", "description", "user_id"
    )


@plans.add("commented_incidents", sql(*INCIDENTS, COMMENTS, """SELECT i.alert_id, greatest(i.updated_at, coalesce(c.commented_at, i.updated_at)) AS updated_at
  FROM incidents i LEFT JOIN comments c ON i.alert_id = c.alert_id AND trim(c.comment) <> ''"""))
def _(spark, d):
    return incidents.touch_commented(folded(spark, d), comments(spark, d)).select("alert_id", "updated_at")


@plans.add("related_incidents", sql(*BASE, """SELECT alert_id, correlation_id, created_at FROM alerts WHERE correlation_id = 'trace-7'"""))
def _(spark, d):
    return incidents.related_to(build(spark, d), "trace-7").select("alert_id", "correlation_id", "created_at")


@plans.add("correlation_groups", sql(*BASE, """SELECT correlation_id, count(*) AS incidents, min(created_at) AS first_created,
  max(created_at) AS last_created, arg_min(alert_id, created_at) AS first_alert_id FROM alerts GROUP BY 1 HAVING count(*) > 1"""))
def _(spark, d):
    return incidents.correlation_groups(build(spark, d))


@plans.add("related_alerts", sql(*BASE, """SELECT alert_id, count(*) OVER (PARTITION BY correlation_id) - 1 AS related_count,
  lag(alert_id) OVER (PARTITION BY correlation_id ORDER BY created_at, alert_id) AS previous_related FROM alerts"""))
def _(spark, d):
    return incidents.with_related(build(spark, d)).select("alert_id", "related_count", "previous_related")


@plans.add("escalate_unanswered", sql(*LIFE, """latest AS (SELECT alert_id, arg_max(status, version_no) AS status, any_value(created_at) AS created_at FROM versions GROUP BY 1)""",
  """SELECT alert_id, 1::INTEGER AS escalation_level FROM latest WHERE status = 'OPEN' AND created_at <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1800 SECOND"""))
def _(spark, d):
    return alerts.escalate(versions(spark, d), at("2024-01-20 00:00:00")).select("alert_id", "escalation_level")


@plans.add("drop_old_closed", sql(*INCIDENTS, """SELECT alert_id, status FROM incidents
  WHERE NOT (status = 'CLOSED' AND created_at < TIMESTAMP '2024-02-20 00:00:00' - INTERVAL 30 DAY)"""))
def _(spark, d):
    kept = retention.drop_old_closed(folded(spark, d), at("2024-02-20 00:00:00"), retention.KEEP_DAYS["development"])
    return kept.select("alert_id", "status")


@plans.add("drop_expired", sql(*INCIDENTS, """SELECT alert_id, expires_at FROM incidents WHERE expires_at > TIMESTAMP '2024-04-15 00:00:00'"""))
def _(spark, d):
    return retention.drop_expired(folded(spark, d), at("2024-04-15 00:00:00")).select("alert_id", "expires_at")


@plans.add("archive_split", sql(*INCIDENTS, """SELECT CASE WHEN created_at < TIMESTAMP '2024-07-15 00:00:00' - INTERVAL 180 DAY THEN 'archive' ELSE 'live' END AS store,
  created_at::DATE AS created_date, count(*) AS incidents FROM incidents GROUP BY ALL"""))
def _(spark, d):
    split = retention.archive_split(folded(spark, d), at("2024-07-15 00:00:00"))
    return split.groupBy("store", "created_date").agg(F.count("*").alias("incidents"))
