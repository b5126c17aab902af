"""Scored logs to alerts, and the routing of alerts to topics and queues."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.functions import rules

TOPIC_CRITICAL = "alerts.critical"
TOPIC_INFO = "alerts.info"
# Queues and their message life time in seconds.
QUEUE_TTL = {"notifications": 3600, "auto-actions": 1800, "critical-alerts": 7200}


def alert_candidates(scored: DataFrame, min_score: float = 0.1) -> DataFrame:
    return scored.filter(F.col("anomaly_score") > F.lit(float(min_score)))


def alert_title(sev: Column) -> Column:
    return F.concat(
        sev,
        F.lit(" Alert: "),
        rules.text_or_null(F.col("anomaly_type")),
        F.lit(" anomaly detected in "),
        rules.text_or_null(F.col("service_name")),
    )


def alert_description() -> Column:
    def line(label: str, col: str) -> Column:
        return F.concat(F.lit(f"{label}: "), rules.text_or_null(F.col(col)), F.lit("\n"))

    nothing = F.lit("")
    reasons = F.col("anomaly_reasons")
    return F.concat(
        line("Anomaly detected with score", "anomaly_score"),
        line("Service", "service_name"),
        line("Host", "hostname"),
        F.when(F.col("pod_name").isNotNull(), line("Pod", "pod_name")).otherwise(nothing),
        line("Log Level", "level"),
        line("Message", "message"),
        F.when(F.size(reasons) > 0, F.concat(F.lit("Reasons: "), F.array_join(reasons, ", "))).otherwise(nothing),
    )


def fingerprint() -> Column:
    """Base64 of the MD5 over the plain concatenation; missing parts print as null."""
    parts = [rules.text_or_null(F.col(c)) for c in ("service_name", "hostname", "anomaly_type", "level")]
    return F.base64(F.unhex(F.md5(F.concat(*parts))))


def alert_id() -> Column:
    return F.concat(F.lit("ALERT-"), F.upper(rules.short_hash(F.col("id"))))


def correlation_id() -> Column:
    return F.coalesce(F.col("trace_id"), F.concat(F.lit("COR-"), rules.short_hash(F.col("id"))))


def iso_time(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def enrich_metadata() -> Column:
    """Original map overlaid with the alert's own keys, which win over equal keys."""
    base = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    scores = F.col("feature_scores")
    own = {
        "originalTimestamp": iso_time("event_ts"),
        "scoredAt": iso_time("scored_at"),
        "traceId": F.col("trace_id"),
        "spanId": F.col("span_id"),
    }
    fixed = F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v)])
    extra = F.when(
        scores.isNotNull(), F.create_map(F.lit("featureScores"), F.to_json(scores))
    ).otherwise(F.create_map().cast("map<string,string>"))
    names = [*own, "featureScores"]
    kept = F.map_filter(base, lambda k, v: ~k.isin(*own) & ~((k == names[-1]) & scores.isNotNull()))
    return F.map_concat(kept, fixed, extra)


def alert_tags() -> Column:
    def tag(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix), value)

    return rules.present(
        tag("service:", rules.text_or_null(F.col("service_name"))),
        tag("level:", F.lower("level")),
        tag("anomaly_type:", rules.text_or_null(F.col("anomaly_type"))),
        tag("host:", F.col("hostname")),
        tag("pod:", F.col("pod_name")),
    )


def build_alerts(scored: DataFrame, thresholds: Mapping[str, float] = rules.SEVERITY_THRESHOLDS) -> DataFrame:
    """One OPEN alert per scored row; event time is the creation time."""
    sev = rules.severity(F.col("anomaly_score"), thresholds)
    return scored.select(
        alert_id().alias("alert_id"),
        correlation_id().alias("correlation_id"),
        F.col("id").alias("source_log_id"),
        "service_name",
        "hostname",
        "pod_name",
        sev.alias("severity"),
        F.lit("OPEN").alias("status"),
        alert_title(sev).alias("title"),
        alert_description().alias("description"),
        "anomaly_score",
        "anomaly_reasons",
        "anomaly_type",
        F.col("event_ts").alias("created_at"),
        F.col("event_ts").alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        enrich_metadata().alias("metadata"),
        alert_tags().alias("tags"),
        F.lit(None).cast("string").alias("assignee"),
        F.lit(0).alias("escalation_level"),
        F.lit(True).alias("suppress_duplicates"),
        fingerprint().alias("fingerprint"),
    )


def route_topic(alerts: DataFrame) -> DataFrame:
    urgent = F.col("severity").isin("CRITICAL", "HIGH")
    return alerts.withColumn("topic", F.when(urgent, F.lit(TOPIC_CRITICAL)).otherwise(F.lit(TOPIC_INFO)))


def fan_out(alerts: DataFrame, ttl: Mapping[str, int] = QUEUE_TTL) -> DataFrame:
    """One row per (alert, queue) with the header flags and the expiry time."""
    sev = F.col("severity")

    def copy(queue: str, wanted: Column, action: bool, urgent: bool) -> Column:
        return F.when(
            wanted,
            F.struct(
                F.lit(queue).alias("queue"),
                F.lit(action).alias("action_required"),
                F.lit(urgent).alias("urgent"),
                F.lit(int(ttl[queue])).alias("ttl_s"),
            ),
        )

    copies = rules.present(
        copy("notifications", F.lit(True), False, False),
        copy("auto-actions", sev.isin("CRITICAL", "HIGH"), True, False),
        copy("critical-alerts", sev == "CRITICAL", False, True),
    )
    out = alerts.withColumn("_q", F.explode(copies)).select(*alerts.columns, "_q.*")
    return out.withColumn("expires_at", F.expr("created_at + make_dt_interval(0, 0, 0, ttl_s)")).drop("ttl_s")


def live_deliveries(deliveries: DataFrame, as_of: Column) -> DataFrame:
    return deliveries.filter((F.col("created_at") <= as_of) & (F.col("expires_at") > as_of))


def latest_status(versions: DataFrame) -> DataFrame:
    """Newest version of each alert; partial aggregates keep a hot alert cheap."""
    rest = [c for c in versions.columns if c != "alert_id"]
    newest = F.max_by(F.struct(*rest), F.struct("version_ts", "version_no"))
    return versions.groupBy("alert_id").agg(newest.alias("_v")).select("alert_id", "_v.*")


def escalate(versions: DataFrame, as_of: Column, timeout_s: int = 1800) -> DataFrame:
    """Alerts whose newest version is still OPEN after the timeout, one level up."""
    limit = as_of - F.expr(f"make_dt_interval(0, 0, 0, {int(timeout_s)})")
    return (
        latest_status(versions)
        .filter((F.col("status") == "OPEN") & (F.col("created_at") <= limit))
        .withColumn("escalation_level", F.col("escalation_level") + 1)
    )


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Counts and mean score over every combination of service, severity and topic."""
    return (
        route_topic(alerts)
        .cube("service_name", "severity", "topic")
        .agg(
            F.grouping_id().cast("int").alias("grouping_level"),
            F.count("*").alias("alerts"),
            F.avg("anomaly_score").alias("average_score"),
        )
    )
