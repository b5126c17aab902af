"""Intake and source queries over a raw JSON feed made from the logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.operators import alerts, scoring
from alertflow.plans.alerting import BASE, QUEUES, build
from alertflow.plans.registry import Plans
from alertflow.plans.scoring import DEFAULT
from alertflow.plans.tables import LOGS, logs, sql
from alertflow.session import new_folder
from alertflow.sources import intake
from alertflow.sources import tables as src
from alertflow.streaming import flow

plans = Plans()
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def as_of():
    return F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00"))


def raw_feed(spark, d):
    """One JSON text per log: some cut short, some with an unknown or no level, id or time."""
    rows = logs(spark, d, True)
    k = F.col("line_number") / 5
    record = F.struct(
        F.when(k % 11 != 0, F.col("id")).alias("id"),
        F.col("service_name").alias("serviceName"),
        "hostname",
        F.when(k % 13 == 0, F.lit("CRITICAL")).when(k % 19 != 0, F.col("level")).alias("level"),
        "message",
        F.when(k % 7 != 0, F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("timestamp"),
        F.col("trace_id").alias("traceId"),
        "http_status",
        "duration_ms",
        F.create_map(F.lit("k"), k.cast("int").cast("string")).alias("metadata"),
    )
    text = F.to_json(record)
    return rows.select(F.when(k % 17 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"))


def parsed(spark, d):
    return intake.ingest_logs(raw_feed(spark, d))


FEED = """feed AS (SELECT *, k % 17 = 0 AS cut, CASE WHEN k % 13 = 0 THEN 'CRITICAL' WHEN k % 19 <> 0 THEN level END AS sent_level,
  CASE WHEN k % 11 <> 0 THEN id END AS sent_id, CASE WHEN k % 7 <> 0 THEN event_ts END AS sent_ts FROM logs),
good AS (SELECT * FROM feed WHERE NOT cut AND sent_level IN ('TRACE', 'DEBUG', 'INFO', 'WARN', 'ERROR', 'FATAL'))"""


@plans.add("ingest_logs", sql(LOGS, FEED, """SELECT sent_id AS id, service_name, hostname, sent_level AS level, message, sent_ts AS event_ts,
  trace_id, http_status, duration_ms, k::VARCHAR AS k FROM good"""))
def _(spark, d):
    good, _ = intake.split_malformed(parsed(spark, d))
    return good.select(
        "id", "service_name", "hostname", "level", "message", "event_ts", "trace_id", "http_status", "duration_ms",
        F.col("metadata")["k"].alias("k"),
    )


@plans.add("default_id_and_time", sql(LOGS, FEED, f"""n AS (SELECT *, coalesce(sent_ts, {NOW}) AS t FROM good)""",
  """SELECT coalesce(sent_id, 'LOG-' || substr(sha256(concat_ws('|', service_name, hostname, sent_level, message, coalesce(epoch_us(sent_ts)::VARCHAR, '\\N'),
    row_number() OVER (PARTITION BY sent_id, service_name, hostname, sent_level, message, sent_ts ORDER BY event_id))), 1, 16)) AS id,
  t AS event_ts, message FROM n"""))
def _(spark, d):
    good, _ = intake.split_malformed(parsed(spark, d))
    return intake.normalise_logs(good, as_of()).select("id", "event_ts", "message")


@plans.add("message_headers", sql(LOGS, "SELECT id, service_name AS service, level FROM logs"))
def _(spark, d):
    rows = intake.with_headers(logs(spark, d))
    value = lambda i: F.decode(F.col("headers")[i]["value"], "UTF-8")
    return rows.select("id", value(0).alias("service"), value(1).alias("level"))


@plans.add("delivery_headers", sql(*BASE, QUEUES, """SELECT alert_id, queue, 'alertId=' || alert_id || ',severity=' || severity || ',serviceName=' || service_name
  || CASE WHEN action_required THEN ',actionRequired=true' ELSE '' END || CASE WHEN urgent THEN ',urgent=true' ELSE '' END AS headers FROM queued"""))
def _(spark, d):
    rows = intake.delivery_headers(alerts.fan_out(build(spark, d)))
    text = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select("alert_id", "queue", text.alias("headers"))


@plans.add("order_by_service", sql(LOGS, "SELECT id, service_name, event_ts FROM logs"))
def _(spark, d):
    return intake.partition_by_service(logs(spark, d)).select("id", "service_name", "event_ts")


@plans.add("malformed_records", sql(LOGS, FEED, """SELECT CASE WHEN cut THEN 'not a valid record' WHEN sent_level IS NULL THEN 'missing level'
  ELSE 'unknown level ' || sent_level END AS reject_reason, count(*) AS records FROM feed WHERE cut OR sent_level IS NULL OR sent_level = 'CRITICAL' GROUP BY 1"""))
def _(spark, d):
    _, bad = intake.split_malformed(parsed(spark, d))
    return bad.groupBy("reject_reason").agg(F.count("*").alias("records"))


@plans.add("dead_letters", sql(LOGS, FEED, f"""SELECT CASE WHEN sent_id IS NOT NULL THEN event_id END AS event_id,
  CASE WHEN NOT cut THEN k END::INTEGER AS k, CASE WHEN cut THEN 'not a valid record' WHEN sent_level IS NULL THEN 'missing level'
  ELSE 'unknown level CRITICAL' END AS reject_reason, {NOW} AS rejected_at FROM feed WHERE cut OR sent_level IS NULL OR sent_level = 'CRITICAL'"""))
def _(spark, d):
    _, bad = intake.split_malformed(parsed(spark, d))
    item = lambda path: F.get_json_object("payload", path)
    # a payload that was cut short still shows its id
    sent = F.nullif(F.regexp_extract("payload", r'"id":"log-(\d+)"', 1), F.lit(""))
    return intake.dead_letters(bad, as_of()).select(
        sent.cast("bigint").alias("event_id"), item("$.metadata.k").cast("int").alias("k"), "reject_reason", "rejected_at"
    )


@plans.add("union_topics", sql(*BASE, "SELECT alert_id, topic FROM alerts"))
def _(spark, d):
    routed = alerts.route_topic(build(spark, d))
    parts = [routed.filter(F.col("topic") == t) for t in (alerts.TOPIC_CRITICAL, alerts.TOPIC_INFO)]
    return src.union_topics(*parts).select("alert_id", "topic")


@plans.add("tail_read", sql(*BASE, "SELECT alert_id FROM alerts WHERE created_at >= TIMESTAMP '2024-01-25 00:00:00'"))
def _(spark, d):
    return src.tail(build(spark, d), F.to_timestamp_ntz(F.lit("2024-01-25 00:00:00"))).select("alert_id")


@plans.add("dedupe_deliveries", sql(LOGS, """SELECT id, event_ts, CASE WHEN k % 2 = 0 THEN 'again ' || message ELSE message END AS message FROM logs"""))
def _(spark, d):
    rows = logs(spark, d)
    later = rows.withColumn("event_ts", F.expr("event_ts + INTERVAL '1' SECOND"))
    altered = rows.withColumn("message", F.concat(F.lit("again "), "message"))
    k = F.col("line_number") / 5
    # the later copy loses; of two copies of one time the smaller text wins
    copies = later.unionByName(rows.filter(k % 2 != 0)).unionByName(altered.filter(k % 2 == 0))
    return intake.dedupe(copies).select("id", "event_ts", "message")


@plans.add("kafka_rows", sql(LOGS, DEFAULT, "SELECT service_name AS key, id, anomaly_score FROM scored_default"))
def _(spark, d):
    rows = src.kafka_rows(scoring.score_default(logs(spark, d)))
    item = lambda path: F.get_json_object("value", path)
    return rows.select("key", item("$.id").alias("id"), item("$.anomaly_score").cast("double").alias("anomaly_score"))


@plans.add("routed_folders", sql(*BASE, "SELECT alert_id, 7::INTEGER AS batch, 'batch=7/topic=' || topic AS folder FROM alerts"))
def _(spark, d):
    rows, by = src.routed_rows(build(spark, d), 7)
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in by])
    return rows.select("alert_id", "batch", folder.alias("folder"))


@plans.add("restarted_read", sql(LOGS, DEFAULT, "SELECT id, anomaly_score FROM scored_default"))
def _(spark, d):
    """Scored logs that arrive in two parts, read by a stream that stops after the first and goes on: each row once."""
    folder = new_folder(spark, "restarted-read")
    scored = scoring.score_default(logs(spark, d))
    for part in (0, 1):
        src.write_scored(scored.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == part), f"{folder}/scored")
        stream = src.read_scored(spark, f"{folder}/scored", streaming=True).select("id", "anomaly_score")
        sink = stream.writeStream.format("parquet").option("path", f"{folder}/seen").option("checkpointLocation", f"{folder}/offsets")
        sink.trigger(**flow.ONCE).start().awaitTermination()
    return spark.read.schema("id string, anomaly_score double").parquet(f"{folder}/seen")


@plans.add("running_counters", sql(*BASE, """SELECT service_name, severity, status, count(*) AS alerts, max(created_at) AS last_seen
  FROM alerts GROUP BY ALL"""))
def _(spark, d):
    return flow.running_counters(build(spark, d))
