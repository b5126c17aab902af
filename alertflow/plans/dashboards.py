"""Dashboard, summary and alarm queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from alertflow.operators import dashboards as db
from alertflow.plans.alerting import BASE, build
from alertflow.plans.lifecycle import INCIDENTS, LIFE, folded, versions
from alertflow.plans.registry import Plans
from alertflow.plans.tables import sql

plans = Plans()
NOW = "TIMESTAMP '2024-01-30 12:00:00'"
RECENT = "recent AS (SELECT * FROM alerts)"
r6 = lambda c: F.round(c, 6).alias(c)


def as_of():
    return F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00"))


@plans.add("dashboard_counters", sql(*LIFE, """SELECT 'service_name' AS dimension, service_name AS value, count(*) AS alerts FROM versions GROUP BY ALL
  UNION ALL SELECT 'severity', severity, count(*) FROM versions GROUP BY ALL
  UNION ALL SELECT 'status', status, count(*) FROM versions GROUP BY ALL"""))
def _(spark, d):
    return db.counters(versions(spark, d))


@plans.add("alerts_by_service", sql(*BASE, "SELECT service_name, count(*) AS alerts FROM alerts GROUP BY ALL"))
def _(spark, d):
    return db.count_by(build(spark, d), "service_name")


@plans.add("average_score_by_service", sql(*BASE, RECENT, """SELECT service_name, round(avg(anomaly_score), 6) AS average_score
  FROM recent GROUP BY ALL"""))
def _(spark, d):
    return db.average_score_by_service(build(spark, d)).select("service_name", r6("average_score"))


@plans.add("count_in_range", sql(*BASE, RECENT, """SELECT count(*) AS alerts FROM recent
  WHERE created_at BETWEEN TIMESTAMP '2024-01-29 00:00:00' AND TIMESTAMP '2024-01-30 00:00:00'"""))
def _(spark, d):
    return db.count_in_range(build(spark, d), dt.datetime(2024, 1, 29), dt.datetime(2024, 1, 30))


BACK = ", ".join(
    f"count(*) FILTER (created_at BETWEEN {NOW} - INTERVAL {m} MINUTE AND {NOW}) AS {n}" for n, m in db.LOOK_BACKS.items()
)


@plans.add("look_back_counts", sql(*BASE, RECENT, f"SELECT {BACK} FROM recent"))
def _(spark, d):
    return db.look_back_counts(build(spark, d), as_of())


@plans.add("alert_time_series", sql(*BASE, f"""SELECT date_trunc('minute', created_at) AS minute, count(*) AS alerts FROM alerts
  WHERE created_at <= {NOW} AND date_trunc('minute', created_at) >= {NOW} - INTERVAL 1 DAY GROUP BY ALL"""))
def _(spark, d):
    return db.time_series(build(spark, d), as_of())


HEALTH = "greatest(0, least(100, 100::DOUBLE - 20 * count(*) FILTER (severity = 'CRITICAL') - 10 * count(*) FILTER (severity = 'HIGH')))::DOUBLE"


@plans.add("system_health", sql(*BASE, f"SELECT {HEALTH} AS system_health FROM alerts"))
def _(spark, d):
    return db.system_health(build(spark, d))


@plans.add("service_status", sql(*BASE, RECENT, """s AS (SELECT service_name, bool_or(severity = 'CRITICAL') AS c, bool_or(severity = 'HIGH') AS h FROM recent GROUP BY 1)""",
  """SELECT a.service_name, CASE WHEN c THEN 'CRITICAL' WHEN h THEN 'DEGRADED' ELSE 'HEALTHY' END AS service_status
  FROM (SELECT DISTINCT service_name FROM alerts) a LEFT JOIN s ON a.service_name = s.service_name"""))
def _(spark, d):
    return db.service_status(build(spark, d))


@plans.add("top_services", sql(*BASE, """SELECT service_name, count(*) AS alerts FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""))
def _(spark, d):
    return db.top_services(build(spark, d))


@plans.add("recent_alerts", sql(*BASE, "SELECT alert_id, created_at FROM alerts ORDER BY created_at DESC, alert_id LIMIT 20"))
def _(spark, d):
    return db.recent_alerts(build(spark, d)).select("alert_id", "created_at")


@plans.add("recent_alerts_of_service", sql(*BASE, RECENT, """SELECT alert_id, service_name, created_at FROM recent
  WHERE service_name = 'auth-service' ORDER BY created_at DESC, alert_id LIMIT 20"""))
def _(spark, d):
    return db.recent_of_service(build(spark, d), "auth-service").select("alert_id", "service_name", "created_at")


@plans.add("newest_alerts_per_service", sql(*BASE, """SELECT alert_id, service_name, r::INTEGER AS recency FROM (
  SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY created_at DESC, alert_id) AS r FROM alerts) WHERE r <= 10"""))
def _(spark, d):
    return db.newest_per_service(build(spark, d)).select("alert_id", "service_name", "recency")


SEV = ", ".join(f"(SELECT count(*) FROM alerts WHERE severity = '{s}') AS {s.lower()}_alerts" for s in db.SEVERITIES)
STA = ", ".join(f"(SELECT count(*) FROM alerts WHERE status = '{s}') AS {s.lower()}_status_alerts" for s in db.SHOWN_STATUSES)
pairs = lambda m: F.array_join(
    F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
)


@plans.add("dashboard_metrics", sql(*BASE, RECENT, f"""SELECT {NOW} AS timestamp, (SELECT count(*) FROM recent) AS total_alerts, {SEV}, {STA},
  (SELECT string_agg(service_name || '=' || n, ',' ORDER BY service_name) FROM (SELECT service_name, count(*) AS n FROM alerts GROUP BY 1)) AS alerts_by_service,
  (SELECT string_agg(service_name || '=' || s, ',' ORDER BY service_name) FROM (SELECT service_name,
    CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(severity = 'HIGH') THEN 'DEGRADED' ELSE 'HEALTHY' END AS s FROM recent GROUP BY 1)) AS service_status,
  (SELECT round(avg(anomaly_score), 6) FROM recent WHERE service_name = 'auth-service') AS auth_score,
  (SELECT count(*) FROM recent WHERE created_at BETWEEN {NOW} - INTERVAL 5 MINUTE AND {NOW}) AS alerts_last_5_minutes,
  (SELECT count(*) FROM recent WHERE created_at BETWEEN {NOW} - INTERVAL 60 MINUTE AND {NOW}) AS alerts_last_hour,
  (SELECT count(*) FROM recent WHERE created_at BETWEEN {NOW} - INTERVAL 1 DAY AND {NOW}) AS alerts_last_24_hours,
  (SELECT {HEALTH} FROM alerts) AS system_health_score,
  (SELECT count(*)::DOUBLE FROM recent WHERE created_at BETWEEN {NOW} - INTERVAL 30 MINUTE AND {NOW}) AS trend_30"""))
def _(spark, d):
    m = db.dashboard_metrics(build(spark, d), as_of())
    return m.withColumns(
        {
            "auth_score": F.round(F.col("average_score_by_service")["auth-service"], 6),
            "trend_30": F.col("alert_trends")["last30min"],
            "alerts_by_service": pairs("alerts_by_service"),
            "service_status": pairs("service_status"),
        }
    ).drop("average_score_by_service", "alert_trends")


@plans.add("dashboard_summary", sql(*BASE, RECENT, f"""SELECT (SELECT count(*) FROM recent) AS total_alerts,
  (SELECT count(*) FROM alerts WHERE severity = 'CRITICAL') AS critical_alerts,
  (SELECT string_agg(alert_id, ',' ORDER BY created_at DESC, alert_id) FROM (SELECT * FROM recent ORDER BY created_at DESC, alert_id LIMIT 10)) AS recent_alerts,
  (SELECT string_agg(service_name || '=' || n, ',' ORDER BY n DESC, service_name) FROM (SELECT service_name, count(*) AS n FROM alerts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)) AS top_services,
  (SELECT {HEALTH} FROM alerts) AS system_health, {NOW} AS last_updated"""))
def _(spark, d):
    s = db.dashboard_summary(build(spark, d), as_of())
    return s.withColumns(
        {
            "recent_alerts": F.array_join(F.col("recent_alerts.alert_id"), ","),
            "top_services": F.array_join(
                F.transform("top_services", lambda x: F.concat(x["service_name"], F.lit("="), x["alerts"].cast("string"))), ","
            ),
        }
    )


@plans.add("dashboard_status", sql(*BASE, RECENT, f"""SELECT 'active' AS status, (SELECT count(*) FROM recent) AS total_alerts,
  (SELECT count(*) FROM alerts WHERE severity = 'CRITICAL') AS critical_alerts, (SELECT {HEALTH} FROM alerts) AS system_health, {NOW} AS last_updated"""))
def _(spark, d):
    return db.dashboard_status(db.dashboard_metrics(build(spark, d), as_of()))


@plans.add("average_resolution_minutes", sql(*INCIDENTS, """SELECT round(avg(time_to_resolve / 60000::DOUBLE), 6) AS average_resolution_minutes FROM incidents"""))
def _(spark, d):
    return db.average_resolution_minutes(folded(spark, d)).select(r6("average_resolution_minutes"))


def summary_sql(minutes):
    bucket = f"time_bucket(INTERVAL {minutes} MINUTE, created_at, TIMESTAMP '2000-01-01')"
    return f"""b AS (SELECT *, {bucket} AS w, coalesce(anomaly_type, 'null') AS kind FROM incidents),
  kinds AS (SELECT service_name, w, string_agg(kind || '=' || n, ',' ORDER BY kind) AS incidents_by_type FROM (SELECT service_name, w, kind, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL),
  hosts AS (SELECT service_name, w, string_agg(hostname || '=' || n, ',' ORDER BY hostname) AS incidents_by_host FROM (SELECT service_name, w, hostname, count(*) AS n FROM b GROUP BY ALL) GROUP BY ALL),
  nums AS (SELECT service_name, w, count(*) AS total_incidents,
    {', '.join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}_incidents" for s in db.SEVERITIES)},
    count(*) FILTER (status IN ('RESOLVED', 'CLOSED')) AS resolved_incidents, count(*) FILTER (status NOT IN ('RESOLVED', 'CLOSED')) AS open_incidents,
    round(avg(anomaly_score), 6) AS average_anomaly_score, round(coalesce(avg(time_to_resolve) / 60000, 0), 6) AS average_time_to_resolve,
    round(coalesce(avg(time_to_acknowledge) / 60000, 0), 6) AS average_time_to_acknowledge FROM b GROUP BY ALL)"""


def summary_query(name, minutes):
    select = f"""SELECT n.* EXCLUDE (w), n.w AS window_start, n.w + INTERVAL {minutes} MINUTE AS window_end,
      n.w + INTERVAL {minutes} MINUTE AS created_at, n.w + INTERVAL {minutes} MINUTE + INTERVAL 180 DAY AS expires_at,
      k.incidents_by_type, h.incidents_by_host
      FROM nums n JOIN kinds k ON n.service_name = k.service_name AND n.w = k.w JOIN hosts h ON n.service_name = h.service_name AND n.w = h.w"""

    @plans.add(name, sql(*INCIDENTS, summary_sql(minutes), select))
    def _(spark, d):
        s = db.incident_summary(folded(spark, d), minutes)
        return s.withColumns(
            {
                "incidents_by_type": pairs("incidents_by_type"),
                "incidents_by_host": pairs("incidents_by_host"),
                **{c: F.round(c, 6) for c in s.columns if c.startswith("average_")},
            }
        )


summary_query("incident_summary_15_minutes", 15)
summary_query("incident_summary_5_minutes", 5)


@plans.add("incident_stats_rollup", sql(*INCIDENTS, """SELECT service_name, severity, grouping(service_name, severity)::INTEGER AS grouping_level,
  count(*) AS incidents, round(avg(anomaly_score), 6) AS average_score, max(impact_score) AS max_impact
  FROM incidents WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' GROUP BY ROLLUP (service_name, severity)"""))
def _(spark, d):
    return db.stats_summary(folded(spark, d), start=dt.datetime(2024, 1, 5)).withColumn(
        "average_score", F.round("average_score", 6)
    )


@plans.add("volume_alarms", sql(*INCIDENTS, """w AS (SELECT service_name, time_bucket(INTERVAL 24 HOUR, created_at, TIMESTAMP '2000-01-01') AS window_start,
  count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c FROM incidents GROUP BY ALL)""", """SELECT service_name, window_start,
  concat_ws(',', CASE WHEN n >= 45 THEN 'high_volume' END, CASE WHEN c >= 15 THEN 'critical_volume' END) AS alarms FROM w WHERE n >= 45 OR c >= 15"""))
def _(spark, d):
    hits = db.volume_alarms(db.incident_summary(folded(spark, d), 1440), total=45, critical=15)
    return hits.select("service_name", "window_start", F.array_join("alarms", ",").alias("alarms"))


@plans.add("latency_alarms", sql(*INCIDENTS, """SELECT alert_id, date_diff('millisecond', created_at, updated_at) AS processing_ms FROM incidents
  WHERE date_diff('millisecond', created_at, updated_at) > 5000"""))
def _(spark, d):
    return db.latency_alarms(folded(spark, d)).select("alert_id", "processing_ms")
