"""Dashboard counters, look-backs, health, time series and windowed incident summaries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertflow.functions import rules
from alertflow.schemas import SEVERITIES

# Look-back names and their length in minutes.
LOOK_BACKS = {"last5min": 5, "last15min": 15, "last30min": 30, "lastHour": 60, "last24Hours": 1440}
TRENDS = ("last5min", "last15min", "last30min", "lastHour")
SHOWN_STATUSES = ("OPEN", "ACKNOWLEDGED", "INVESTIGATING", "RESOLVED")
# Volume alarms.
ALARM_TOTAL, ALARM_CRITICAL, ALARM_LATENCY_MS = 100, 10, 5000
SUMMARY_DAYS = 180


def minutes_before(as_of: Column, minutes: int) -> Column:
    return as_of - F.expr(f"make_dt_interval(0, 0, {int(minutes)}, 0)")


def count_by(alerts: DataFrame, column: str) -> DataFrame:
    return alerts.groupBy(column).agg(F.count("*").alias("alerts"))


def counters(alerts: DataFrame) -> DataFrame:
    """The three life-time counters in one pass: (dimension, value, alerts)."""
    names = ("service_name", "severity", "status")
    sets = alerts.groupingSets([[n] for n in names], *names).agg(
        F.grouping_id(*names).alias("_g"), F.count("*").alias("alerts")
    )
    return sets.select(
        F.when(F.col("_g") == 3, "service_name").when(F.col("_g") == 5, "severity").otherwise("status").alias("dimension"),
        F.coalesce(*names).alias("value"),
        "alerts",
    )


def recent_alerts(alerts: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first. Top-k keeps ``limit`` rows per task; no full sort."""
    return alerts.orderBy(F.desc("created_at"), F.asc("alert_id")).limit(limit)


def newest(alerts: DataFrame, history: int | None) -> DataFrame:
    """All alerts, or the newest ``history`` of them where a caller wants a ring of fixed length."""
    return alerts if history is None else recent_alerts(alerts, history)


def recent_of_service(alerts: DataFrame, service: str, limit: int = 20, history: int | None = None) -> DataFrame:
    """Newest alerts of one service."""
    return recent_alerts(newest(alerts, history).filter(F.col("service_name") == service), limit)


def newest_per_service(alerts: DataFrame, limit: int = 10) -> DataFrame:
    w = Window.partitionBy("service_name").orderBy(F.desc("created_at"), F.asc("alert_id"))
    return alerts.withColumn("recency", F.row_number().over(w)).filter(F.col("recency") <= limit)


def average_score_by_service(alerts: DataFrame, history: int | None = None) -> DataFrame:
    return newest(alerts, history).groupBy("service_name").agg(F.avg("anomaly_score").alias("average_score"))


def _within(as_of: Column, minutes: int) -> Column:
    at = F.col("created_at")
    return (at >= minutes_before(as_of, minutes)) & (at <= as_of)


def count_in_range(alerts: DataFrame, start, end, history: int | None = None) -> DataFrame:
    """Both ends included; the range reaches the scan as a filter."""
    inside = F.col("created_at").between(F.lit(start), F.lit(end))
    return newest(alerts, history).filter(inside).agg(F.count("*").alias("alerts"))


def look_back_counts(alerts: DataFrame, as_of: Column, history: int | None = None) -> DataFrame:
    """All look-backs from one pass over the alerts of the longest."""
    base = newest(alerts, history).filter(_within(as_of, max(LOOK_BACKS.values())))
    return base.agg(*[F.count_if(_within(as_of, m)).alias(n) for n, m in LOOK_BACKS.items()])


def time_series(alerts: DataFrame, as_of: Column, keep_hours: int = 24) -> DataFrame:
    """Alerts per minute; minutes older than the kept span are filtered at the scan."""
    oldest = minutes_before(as_of, keep_hours * 60)
    return (
        alerts.filter(
            (F.col("created_at") <= as_of)
            & (F.col("created_at") >= oldest)
            & (F.date_trunc("minute", "created_at") >= oldest)
        )
        .groupBy(F.window("created_at", "1 minute")["start"].alias("minute"))
        .agg(F.count("*").alias("alerts"))
    )


def health(total: Column, critical: Column, high: Column) -> Column:
    points = F.lit(100.0) - critical * F.lit(20.0) - high * F.lit(10.0)
    return F.when(total == 0, F.lit(100.0)).otherwise(rules.clamp(points, 0.0, 100.0))


def system_health(alerts: DataFrame) -> DataFrame:
    counts = alerts.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in ("CRITICAL", "HIGH")]
    )
    return counts.select(health(F.col("_n"), F.col("_CRITICAL"), F.col("_HIGH")).alias("system_health"))


def service_status(alerts: DataFrame, since=None) -> DataFrame:
    """Worst severity per service, from ``since`` on if given; every service ever seen is listed."""
    counted = F.lit(True) if since is None else F.col("created_at") >= since
    worst = alerts.groupBy("service_name").agg(
        F.bool_or(counted & (F.col("severity") == "CRITICAL")).alias("_c"),
        F.bool_or(counted & (F.col("severity") == "HIGH")).alias("_h"),
    )
    return worst.select(
        "service_name",
        F.when(F.col("_c"), F.lit("CRITICAL")).when(F.col("_h"), F.lit("DEGRADED")).otherwise(F.lit("HEALTHY")).alias(
            "service_status"
        ),
    )


def top_services(alerts: DataFrame, limit: int = 5) -> DataFrame:
    return count_by(alerts, "service_name").orderBy(F.desc("alerts"), F.asc("service_name")).limit(limit)


def dashboard_metrics(alerts: DataFrame, as_of: Column) -> DataFrame:
    """One record: counters, scores, states and look-backs over all alerts.

    One aggregate by service, with severities, statuses and look-backs pivoted inside it; the record is folded from its
    rows, of which there are as many as services.
    """
    both = alerts.groupBy("service_name").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_status") for s in SHOWN_STATUSES],
        F.avg("anomaly_score").alias("score"),
        F.bool_or(F.col("severity") == "CRITICAL").alias("c"),
        F.bool_or(F.col("severity") == "HIGH").alias("h"),
        *[F.count_if(_within(as_of, m)).alias(n) for n, m in LOOK_BACKS.items()],
    )
    status = F.when(F.col("c"), F.lit("CRITICAL")).when(F.col("h"), F.lit("DEGRADED")).otherwise(F.lit("HEALTHY"))

    def total(col: str) -> Column:
        return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")

    def as_map(value: Column, keep: Column | None = None) -> Column:
        pair = F.struct("service_name", value)
        return F.map_from_entries(F.array_sort(F.collect_list(pair if keep is None else F.when(keep, pair))))

    row = both.agg(
        total("n").alias("total_alerts"),
        *[total(s.lower()).alias(f"{s.lower()}_alerts") for s in SEVERITIES],
        *[total(f"{s.lower()}_status").alias(f"{s.lower()}_status_alerts") for s in SHOWN_STATUSES],
        as_map(F.col("n")).alias("alerts_by_service"),
        as_map(F.col("score"), F.col("score").isNotNull()).alias("average_score_by_service"),
        as_map(status).alias("service_status"),
        *[total(n).alias(f"_{n}") for n in LOOK_BACKS],
    )
    trend = [x for n in TRENDS for x in (F.lit(n), F.col(f"_{n}").cast("double"))]
    return row.select(
        as_of.alias("timestamp"),
        *[c for c in row.columns if not c.startswith("_")],
        F.col("_last5min").alias("alerts_last_5_minutes"),
        F.col("_lastHour").alias("alerts_last_hour"),
        F.col("_last24Hours").alias("alerts_last_24_hours"),
        health(F.col("total_alerts"), F.col("critical_alerts"), F.col("high_alerts")).alias("system_health_score"),
        F.create_map(*trend).alias("alert_trends"),
    )


def dashboard_summary(alerts: DataFrame, as_of: Column, recent: int = 10, top: int = 5) -> DataFrame:
    """Head numbers with the newest alerts and the busiest services as nested lists (bounded by their limits)."""
    def ordered(rank: Column, *names: str) -> Column:
        entries = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), *names)))
        return F.transform(entries, lambda x: F.struct(*[x[n].alias(n) for n in names]))

    last = recent_alerts(alerts, recent).agg(ordered(-_micros("created_at"), "alert_id", "title"))
    busy = top_services(alerts, top).agg(ordered(-F.col("alerts"), "service_name", "alerts"))
    return dashboard_metrics(alerts, as_of).select(
        "total_alerts",
        "critical_alerts",
        last.scalar().alias("recent_alerts"),
        busy.scalar().alias("top_services"),
        F.col("system_health_score").alias("system_health"),
        F.col("timestamp").alias("last_updated"),
    )


def _micros(col: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {col})")


def dashboard_status(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        F.lit("active").alias("status"),
        "total_alerts",
        "critical_alerts",
        F.col("system_health_score").alias("system_health"),
        F.col("timestamp").alias("last_updated"),
    )


def average_resolution_minutes(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.avg(F.col("time_to_resolve") / F.lit(60_000.0)).alias("average_resolution_minutes"))


# -- incident summaries --------------------------------------------------------


def incident_summary(incidents: DataFrame, minutes: int = 15) -> DataFrame:
    """Per service and tumbling window.

    One pass groups by (service, window, type) and (service, window, host) at
    once; the second level only sees those combined rows, so the maps are built
    from as many entries as there are types and hosts.
    """
    resolved = F.col("status").isin("RESOLVED", "CLOSED")
    keys = ["service_name", "w_start", "kind", "host"]
    fine = (
        incidents.withColumns(
            {
                "w_start": F.window("created_at", f"{int(minutes)} minutes")["start"],
                "kind": rules.text_or_null(F.col("anomaly_type")),
                "host": rules.text_or_null(F.col("hostname")),
            }
        )
        .groupingSets([keys[:3], [*keys[:2], keys[3]]], *keys)
        .agg(
            F.grouping("kind").alias("host_row"),
            F.count("*").alias("n"),
            *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
            F.count_if(resolved).alias("resolved"),
            F.count_if(~resolved).alias("open"),
            F.sum("anomaly_score").alias("score"),
            F.sum("time_to_resolve").alias("ttr"),
            F.count("time_to_resolve").alias("ttr_n"),
            F.sum("time_to_acknowledge").alias("tta"),
            F.count("time_to_acknowledge").alias("tta_n"),
        )
    )
    by_host = F.col("host_row") == 1
    numbers = [s.lower() for s in SEVERITIES] + ["n", "resolved", "open", "score", "ttr", "ttr_n", "tta", "tta_n"]
    entries = lambda name, keep: F.map_from_entries(F.array_sort(F.collect_list(F.when(keep, F.struct(name, "n")))))
    out = fine.groupBy("service_name", "w_start").agg(
        *[F.sum(F.when(~by_host, F.col(c))).alias(c) for c in numbers],
        entries("kind", ~by_host).alias("incidents_by_type"),
        entries("host", by_host).alias("incidents_by_host"),
    )
    minutes_of = lambda t, n: F.coalesce(F.col(t) / F.nullif(F.col(n), F.lit(0)) / F.lit(60_000.0), F.lit(0.0))
    end = f"w_start + INTERVAL '{int(minutes)}' MINUTE"
    return out.select(
        F.col("w_start").alias("window_start"),
        F.expr(end).alias("window_end"),
        "service_name",
        F.col("n").alias("total_incidents"),
        *[F.col(s.lower()).alias(f"{s.lower()}_incidents") for s in SEVERITIES],
        F.col("resolved").alias("resolved_incidents"),
        F.col("open").alias("open_incidents"),
        (F.col("score") / F.col("n")).alias("average_anomaly_score"),
        minutes_of("ttr", "ttr_n").alias("average_time_to_resolve"),
        minutes_of("tta", "tta_n").alias("average_time_to_acknowledge"),
        "incidents_by_type",
        "incidents_by_host",
        F.expr(end).alias("created_at"),
        F.expr(f"{end} + INTERVAL '{SUMMARY_DAYS}' DAY").alias("expires_at"),
    )


def stats_summary(incidents: DataFrame, service: str | None = None, start=None, end=None) -> DataFrame:
    """Totals by service and severity with sub-totals, optionally for one service or range."""
    if service is not None:
        incidents = incidents.filter(F.col("service_name") == service)
    if start is not None:
        incidents = incidents.filter(F.col("created_at") >= F.lit(start))
    if end is not None:
        incidents = incidents.filter(F.col("created_at") < F.lit(end))
    return incidents.rollup("service_name", "severity").agg(
        F.grouping_id().cast("int").alias("grouping_level"),
        F.count("*").alias("incidents"),
        F.avg("anomaly_score").alias("average_score"),
        F.max("impact_score").alias("max_impact"),
    )


def volume_alarms(
    summaries: DataFrame, total: int = ALARM_TOTAL, critical: int = ALARM_CRITICAL
) -> DataFrame:
    """Windows whose volume reaches an alarm threshold."""
    hits: Mapping[str, Column] = {
        "high_volume": F.col("total_incidents") >= total,
        "critical_volume": F.col("critical_incidents") >= critical,
    }
    names = rules.present(*[F.when(c, F.lit(n)) for n, c in hits.items()])
    return summaries.withColumn("alarms", names).filter(F.size("alarms") > 0)


def latency_alarms(incidents: DataFrame, limit_ms: int = ALARM_LATENCY_MS) -> DataFrame:
    """Incidents first processed later than the limit after the log was written."""
    lag = F.expr("timestampdiff(MILLISECOND, created_at, updated_at)")
    return incidents.withColumn("processing_ms", lag).filter(F.col("processing_ms") > limit_ms)
