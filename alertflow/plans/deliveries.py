"""Outbox and response-action queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.functions import rules
from alertflow.operators import alerts, outbox, responder
from alertflow.plans.alerting import BASE, QUEUES, build
from alertflow.plans.registry import Plans
from alertflow.plans.suppression import PLANNED, planned
from alertflow.plans.tables import sql

plans = Plans()
BOTH = (
    {"channel": "EMAIL", "enabled": True, "target": " a@example.com, ,b@example.com,"},
    {"channel": "SLACK", "enabled": True, "target": "#alerts"},
    {"channel": "SMS", "enabled": False, "target": "+100"},
)


@plans.add("channel_fan_out", sql(*BASE, """SELECT alert_id, channel FROM alerts, (VALUES ('EMAIL'), ('SLACK')) c(channel)"""))
def _(spark, d):
    return outbox.fan_out_channels(build(spark, d), BOTH).select("alert_id", "channel")


@plans.add("outbox_once_per_channel", sql(*BASE, QUEUES, """SELECT DISTINCT alert_id, channel, 'PENDING' AS status, 0::INTEGER AS attempts
  FROM queued, (VALUES ('EMAIL'), ('SLACK')) c(channel)"""))
def _(spark, d):
    deliveries = alerts.fan_out(build(spark, d)).drop("queue", "action_required", "urgent", "expires_at")
    return outbox.build_outbox(deliveries, BOTH).select("alert_id", "channel", "status", "attempts")


@plans.add("mail_subject", sql(*BASE, "SELECT alert_id, '[' || severity || '] Alert: ' || title AS subject FROM alerts"))
def _(spark, d):
    return build(spark, d).select("alert_id", outbox.subject().alias("subject"))


@plans.add("mail_recipients", sql(*BASE, """SELECT alert_id, unnest(['a@example.com', service_name || '@example.com']) AS recipient FROM alerts"""))
def _(spark, d):
    raw = F.concat(F.lit(" a@example.com, ,"), F.col("service_name"), F.lit("@example.com ,"))
    return build(spark, d).select("alert_id", F.explode(outbox.recipients(raw)).alias("recipient"))


@plans.add("mail_body", sql(*BASE, """SELECT alert_id, '<html><body><h2>Alert Notification</h2><table border=''1'' cellpadding=''5'' cellspacing=''0''>'
  || '<tr><td><b>Alert ID:</b></td><td>' || alert_id || '</td></tr><tr><td><b>Service:</b></td><td>' || service_name
  || '</td></tr><tr><td><b>Severity:</b></td><td>' || severity || '</td></tr><tr><td><b>Title:</b></td><td>' || title
  || '</td></tr><tr><td><b>Description:</b></td><td>' || description || '</td></tr><tr><td><b>Anomaly Score:</b></td><td>'
  || printf('%.3f', anomaly_score) || '</td></tr><tr><td><b>Time:</b></td><td>' || strftime(created_at, '%Y-%m-%dT%H:%M')
  || CASE WHEN epoch_us(created_at) % 60000000 = 0 THEN '' WHEN epoch_us(created_at) % 1000000 = 0 THEN strftime(created_at, ':%S')
    WHEN epoch_us(created_at) % 1000 = 0 THEN left(strftime(created_at, ':%S.%f'), 7) ELSE strftime(created_at, ':%S.%f') END
  || '</td></tr><tr><td><b>Host:</b></td><td>'
  || hostname || '</td></tr></table></body></html>' AS body FROM alerts"""))
def _(spark, d):
    return build(spark, d).select("alert_id", outbox.html_body().alias("body"))


CHAT = """chr(128680) || ' *' || severity || ' Alert*' || chr(10) || '*Service:* ' || service_name || chr(10) || '*Description:* ' || description
  || chr(10) || '*Score:* ' || printf('%.3f', anomaly_score) || chr(10) || '*Time:* '
  || regexp_replace(strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || chr(10)"""


@plans.add("chat_message", sql(*BASE, f"SELECT alert_id, {CHAT} AS message FROM alerts"))
def _(spark, d):
    return build(spark, d).select("alert_id", outbox.chat_message().alias("message"))


@plans.add("severity_colour", sql(*BASE, """SELECT alert_id, CASE severity WHEN 'CRITICAL' THEN '#FF0000' WHEN 'HIGH' THEN '#FF8C00'
  WHEN 'MEDIUM' THEN '#FFD700' WHEN 'LOW' THEN '#32CD32' ELSE '#1E90FF' END AS colour FROM alerts"""))
def _(spark, d):
    return build(spark, d).select("alert_id", rules.severity_colour(F.col("severity")).alias("colour"))


@plans.add("chat_payload", sql(*BASE, f"""SELECT alert_id, '#alerts' AS channel, {CHAT} AS text, severity AS third_field,
  epoch(created_at)::BIGINT AS sent_at FROM (SELECT *, epoch_us(created_at) AS us FROM alerts)""".replace("epoch(created_at)::BIGINT", "us // 1000000")))
def _(spark, d):
    p = build(spark, d).withColumn("p", outbox.chat_payload())
    item = lambda path: F.get_json_object("p", path)
    return p.select(
        "alert_id", item("$.channel").alias("channel"), item("$.attachments[0].text").alias("text"),
        item("$.attachments[0].fields[2].value").alias("third_field"),
        item("$.attachments[0].timestamp").cast("bigint").alias("sent_at"),
    )


@plans.add("retry_policy", sql(*BASE, QUEUES, """o AS (SELECT DISTINCT alert_id, created_at, event_id, CASE WHEN severity = 'CRITICAL' THEN 'critical-alerts' ELSE 'notifications' END AS queue FROM alerts),
  t AS (SELECT *, event_id % 4 AS before, event_id % 3 = 0 AS delivered FROM o WHERE event_id % 5 <> 0)""",
  """SELECT o.alert_id, CASE WHEN t.alert_id IS NULL THEN 'PENDING' WHEN delivered THEN 'SENT' WHEN before + 1 >= 3 AND t.queue = 'notifications' THEN 'FAILED' ELSE 'RETRY' END AS status,
  (o.event_id % 4 + (t.alert_id IS NOT NULL)::INT)::INTEGER AS attempts,
  CASE WHEN t.alert_id IS NULL THEN o.created_at WHEN NOT delivered AND (t.queue = 'critical-alerts' OR before + 1 < 3)
    THEN o.created_at + to_seconds(60 + CASE before WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 5 END) END AS next_attempt_at
  FROM o LEFT JOIN t ON o.alert_id = t.alert_id"""))
def _(spark, d):
    a = build(spark, d)
    n = F.substring("source_log_id", 5, 20).cast("bigint")
    box = outbox.build_outbox(a, BOTH[:1]).withColumn("attempts", (n % 4).cast("int"))
    outcomes = box.filter(n % 5 != 0).select(
        "alert_id", "channel",
        F.when(F.col("severity") == "CRITICAL", "critical-alerts").otherwise("notifications").alias("queue"),
        (n % 3 == 0).alias("delivered"),
        (F.col("created_at") + F.expr("INTERVAL '1' MINUTE")).alias("attempted_at"),
    )
    # the same message failed in a second queue earlier; it still has one outcome
    earlier = outcomes.withColumns(
        {"queue": F.lit("notifications"), "delivered": F.lit(False),
         "attempted_at": F.col("attempted_at") - F.expr("INTERVAL '30' SECOND")}
    )
    outcomes = outcomes.unionByName(earlier)
    return outbox.after_attempt(box, outcomes).select("alert_id", "status", "attempts", "next_attempt_at")


@plans.add("plan_actions", sql(*BASE, PLANNED, "SELECT alert_id, service_name, action_type FROM planned"))
def _(spark, d):
    return planned(spark, d).select("alert_id", "service_name", "action_type")


@plans.add("plan_actions_from_table", sql(*BASE, """patterns AS (SELECT lower(n_name) || '-service.*' AS pattern FROM nation
  UNION ALL SELECT substr(service_name, 1, 3) || '[a-z]+-serv(er|ice)' FROM alerts WHERE length(service_name) % 2 = 1),
names AS (SELECT DISTINCT service_name FROM alerts, (SELECT DISTINCT pattern FROM patterns) WHERE regexp_full_match(service_name, pattern))""",
  """SELECT alert_id, CASE WHEN severity = 'CRITICAL' THEN 'POD_RESTART' ELSE 'SERVICE_SCALE_UP' END AS action_type
  FROM alerts JOIN names USING (service_name)
  WHERE (severity = 'CRITICAL' AND anomaly_score >= 0.9::DOUBLE) OR (severity = 'HIGH' AND anomaly_score >= 0.7::DOUBLE)"""))
def _(spark, d):
    a = build(spark, d)
    listed = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lower("n_name"), F.lit("-service.*")).alias("pattern"))
    made = a.filter(F.length("service_name") % 2 == 1)
    made = made.select(F.concat(F.substring("service_name", 1, 3), F.lit("[a-z]+-serv(er|ice)")).alias("pattern"))
    return responder.plan_actions_from(a, listed.union(made)).select("alert_id", "action_type")


@plans.add("exclude_services", sql(*BASE, PLANNED, """SELECT alert_id, action_type FROM planned
  WHERE service_name NOT IN (SELECT lower(n_name) || '-service' FROM nation) AND service_name <> 'payment-service'"""))
def _(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    names = nation.select(F.concat(F.lower("n_name"), F.lit("-service")).alias("service_name"))
    listed = names.union(build(spark, d).filter(F.col("service_name") == "payment-service").select("service_name"))
    return responder.exclude_services(planned(spark, d), listed).select("alert_id", "action_type")


@plans.add("action_records", sql(*BASE, PLANNED, """SELECT alert_id, action_type, 'DRY_RUN' AS status, CASE WHEN action_type = 'POD_RESTART'
  THEN 'DRY RUN: Would restart pods for service: ' || service_name ELSE 'DRY RUN: Would scale service: ' || service_name || ' to 6 replicas' END AS description,
  true AS success, true AS dry_run, created_at AS executed_at FROM planned"""))
def _(spark, d):
    size = responder.target_replicas(F.lit(2), F.lit(9))
    return responder.action_records(planned(spark, d), size).drop("action_id", "service_name")


@plans.add("target_replicas", sql("e AS (SELECT event_id, user_id % 7 AS current, event_id % 15 AS wanted FROM events)", """SELECT event_id,
  greatest(1, least(wanted, 10, current * 3)) AS replicas FROM e"""))
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        "event_id", responder.target_replicas(F.col("user_id") % 7, F.col("event_id") % 15).cast("bigint").alias("replicas")
    )
