"""Incident lifecycle as folds over alert versions.

A *version* is an alert row plus ``version_ts`` and ``version_no`` (tie-break).
State is kept as combinable aggregates and the event log as a table of its own,
so an alert with very many versions never becomes one task or one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.functions import rules
from alertflow.operators.ordered import previous_values

INCIDENT_DAYS = 90
ACTOR = "system"
# Points per severity, points per unit of score, and the upper bound.
IMPACT_BASE = {"CRITICAL": 100, "HIGH": 75, "MEDIUM": 50, "LOW": 25, "INFO": 10}
IMPACT_FACTOR = 50
IMPACT_CAP = 200
# Event written for a change to a status; other statuses write CREATED.
STATUS_EVENT = {
    "ACKNOWLEDGED": "ACKNOWLEDGED", "INVESTIGATING": "INVESTIGATING", "RESOLVED": "RESOLVED", "CLOSED": "CLOSED",
}
CREATED_TEXT = "Incident created from alert"

COPIED = (
    "correlation_id", "source_log_id", "service_name", "hostname", "pod_name", "title", "description",
    "anomaly_score", "anomaly_reasons", "anomaly_type", "created_at", "metadata", "tags", "escalation_level",
    "suppress_duplicates", "fingerprint",
)


def impact_score(sev: Column, score: Column) -> Column:
    base = rules.lookup(sev, IMPACT_BASE, 0)
    return F.least(base + (score * F.lit(float(IMPACT_FACTOR))).cast("int"), F.lit(IMPACT_CAP))


def initial_incidents(alerts: DataFrame) -> DataFrame:
    """First state of an incident from its first alert version."""
    return alerts.select(
        "alert_id",
        *COPIED,
        "severity",
        "status",
        "assignee",
        "updated_at",
        "resolved_at",
        F.lit(None).cast("bigint").alias("time_to_acknowledge"),
        F.lit(None).cast("bigint").alias("time_to_resolve"),
        F.lit(0).alias("escalation_count"),
        F.lit(0).alias("notifications_sent"),
        F.lit(0).alias("automated_actions_triggered"),
        F.array("service_name").alias("affected_services"),
        impact_score(F.col("severity"), F.col("anomaly_score")).alias("impact_score"),
        F.expr(f"created_at + INTERVAL '{INCIDENT_DAYS}' DAY").alias("expires_at"),
    )


def changes(versions: DataFrame, bucket_s: int = 86_400) -> DataFrame:
    """Versions with what each one changed against the state before it."""
    seen = previous_values(
        versions, "alert_id", ["version_ts", "version_no"], ["status", "severity"], ["assignee"], bucket_s
    )
    later = ~F.col("is_first")
    return seen.withColumns(
        {
            "status_changed": later & (F.col("status") != F.col("previous_status")),
            "severity_changed": later & (F.col("severity") != F.col("previous_severity")),
            "assignee_changed": later
            & F.col("assignee").isNotNull()
            & ~F.col("assignee").eqNullSafe(F.col("previous_assignee")),
        }
    )


def incident_events(versions: DataFrame, bucket_s: int = 86_400) -> DataFrame:
    """Event log: one row per change, ordered by (event_time, version_no, ord) within an alert."""

    def event(ord_: int, when: Column, kind: Column, text: Column) -> Column:
        return F.when(
            when, F.struct(F.lit(ord_).alias("ord"), kind.alias("event_type"), text.alias("description"))
        )

    status = F.col("status")
    status_kind = rules.lookup(status, STATUS_EVENT, "CREATED")
    items = rules.present(
        event(0, F.col("is_first"), F.lit("CREATED"), F.lit(CREATED_TEXT)),
        event(
            1,
            F.col("status_changed"),
            status_kind,
            F.concat(F.lit("Status changed from "), F.col("previous_status"), F.lit(" to "), status),
        ),
        event(
            2, F.col("severity_changed"), F.lit("ESCALATED"), F.concat(F.lit("Severity changed to "), F.col("severity"))
        ),
        event(3, F.col("assignee_changed"), F.lit("ASSIGNED"), F.concat(F.lit("Assigned to "), F.col("assignee"))),
    )
    rows = changes(versions, bucket_s).select("alert_id", "version_ts", "version_no", F.explode(items).alias("_e"))
    return rows.select(
        "alert_id",
        rules.short_hash(F.concat_ws("|", "alert_id", "version_no", F.col("_e.ord").cast("string"))).alias("event_id"),
        "_e.event_type",
        "_e.description",
        F.lit(ACTOR).alias("user_id"),
        F.col("version_ts").alias("event_time"),
        "version_no",
        "_e.ord",
    )


def fold_incidents(versions: DataFrame, bucket_s: int = 86_400, carried: str | None = None) -> DataFrame:
    """Final incident per alert_id; every column is a combinable aggregate of its versions.

    ``carried`` names a column that is returned as the oldest version has it.
    """
    at = F.struct("version_ts", "version_no")
    changed = F.col("status_changed") | F.col("severity_changed") | F.col("assignee_changed")
    to_resolved = F.col("status_changed") & (F.col("status") == "RESOLVED")
    acked = F.col("status_changed") & (F.col("status") == "ACKNOWLEDGED")
    reopened = F.col("status_changed") & F.col("previous_status").isin("RESOLVED", "CLOSED") & F.col("status").isin(
        "OPEN", "ACKNOWLEDGED", "INVESTIGATING"
    )
    first = F.struct(*COPIED, "severity", "updated_at", "resolved_at", *([carried] if carried else []))
    state = (
        changes(versions, bucket_s)
        .groupBy("alert_id")
        .agg(
            F.min_by(first, at).alias("_f"),
            F.max_by("status", at).alias("status"),
            F.max_by("severity", at).alias("severity"),
            F.max_by("assignee", F.when(F.col("assignee").isNotNull(), at)).alias("assignee"),
            F.min_by(F.coalesce("resolved_at", "version_ts"), F.when(to_resolved, at)).alias("_resolved"),
            F.min(F.when(acked, F.col("version_ts"))).alias("_acked"),
            F.max(F.when(changed, F.col("version_ts"))).alias("_touched"),
            F.count_if("severity_changed").cast("int").alias("escalation_count"),
            F.count_if(reopened).cast("int").alias("reopen_count"),
        )
    )
    resolved = F.coalesce("_f.resolved_at", "_resolved")
    newly = F.col("_f.resolved_at").isNull() & F.col("_resolved").isNotNull()
    millis = "timestampdiff(MILLISECOND, _f.created_at, {})"
    return state.select(
        "alert_id",
        *[F.col(f"_f.{c}").alias(c) for c in COPIED],
        "severity",
        "status",
        "assignee",
        F.coalesce("_touched", "_f.updated_at").alias("updated_at"),
        resolved.alias("resolved_at"),
        F.expr(millis.format("_acked")).alias("time_to_acknowledge"),
        F.when(newly, F.expr(millis.format("_resolved"))).alias("time_to_resolve"),
        "escalation_count",
        "reopen_count",
        F.lit(0).alias("notifications_sent"),
        F.lit(0).alias("automated_actions_triggered"),
        F.array("_f.service_name").alias("affected_services"),
        impact_score(F.col("_f.severity"), F.col("_f.anomaly_score")).alias("impact_score"),
        F.expr(f"_f.created_at + INTERVAL '{INCIDENT_DAYS}' DAY").alias("expires_at"),
        *([F.col(f"_f.{carried}").alias(carried)] if carried else []),
    )


def apply_versions(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Create or update: fold a batch of new versions into the stored incidents they touch.

    A stored incident enters the fold as its own oldest version, so create and
    update are the same aggregate. That version carries the totals that only the
    past knows, so the stored table is read once and nothing is joined.
    """
    totals = (
        "time_to_acknowledge", "time_to_resolve", "escalation_count", "reopen_count", "impact_score",
        "notifications_sent", "automated_actions_triggered",
    )
    base = state.select(
        "alert_id", *COPIED, "severity", "status", "assignee", "updated_at", "resolved_at",
        F.lit(None).cast("timestamp_ntz").alias("version_ts"), F.lit(-1).cast("bigint").alias("version_no"),
        F.struct(*totals).alias("_o"),
    )
    new = batch.withColumns(
        {"version_no": F.col("version_no").cast("bigint"), "_o": F.lit(None).cast(base.schema["_o"].dataType)}
    ).select(*base.columns)
    oldest = F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))
    merged = fold_incidents(base.withColumn("version_ts", oldest).unionByName(new), carried="_o")
    zero = F.lit(0)
    return merged.withColumns(
        {
            "time_to_acknowledge": F.coalesce("_o.time_to_acknowledge", "time_to_acknowledge"),
            "time_to_resolve": F.coalesce("_o.time_to_resolve", "time_to_resolve"),
            "escalation_count": F.col("escalation_count") + F.coalesce("_o.escalation_count", zero),
            "reopen_count": F.col("reopen_count") + F.coalesce("_o.reopen_count", zero),
            "impact_score": F.coalesce("_o.impact_score", "impact_score"),
            "notifications_sent": F.coalesce("_o.notifications_sent", zero),
            "automated_actions_triggered": F.coalesce("_o.automated_actions_triggered", zero),
        }
    ).drop("_o")


def add_comments(events: DataFrame, comments: DataFrame) -> DataFrame:
    """Append COMMENTED events; blank comments are refused, a missing user is ``anonymous``.

    ``comments`` has alert_id, comment, user_id, commented_at.
    """
    said = comments.filter(F.trim("comment") != "")
    rows = said.select(
        "alert_id",
        rules.short_hash(
            F.concat_ws("|", "alert_id", "user_id", F.col("commented_at").cast("string"), "comment")
        ).alias("event_id"),
        F.lit("COMMENTED").alias("event_type"),
        F.col("comment").alias("description"),
        F.coalesce("user_id", F.lit("anonymous")).alias("user_id"),
        F.col("commented_at").alias("event_time"),
        F.lit(None).cast(events.schema["version_no"].dataType).alias("version_no"),
        F.lit(4).alias("ord"),
    )
    known = events.select("alert_id").distinct()
    return events.unionByName(rows.join(known, "alert_id", "left_semi"))


def touch_commented(incidents: DataFrame, comments: DataFrame) -> DataFrame:
    """A comment moves the incident's updated_at forward."""
    newest = comments.filter(F.trim("comment") != "").groupBy("alert_id").agg(F.max("commented_at").alias("_c"))
    return (
        incidents.join(newest, "alert_id", "left")
        .withColumn("updated_at", F.greatest("updated_at", F.coalesce("_c", "updated_at")))
        .drop("_c")
    )


def event_log(events: DataFrame, alert: str) -> DataFrame:
    """History of one incident, oldest first."""
    return events.filter(F.col("alert_id") == alert).orderBy("event_time", F.col("version_no").asc_nulls_last(), "ord")


def related_to(incidents: DataFrame, correlation: str) -> DataFrame:
    return incidents.filter(F.col("correlation_id") == correlation).orderBy("created_at", "alert_id")


def correlation_groups(incidents: DataFrame) -> DataFrame:
    """One row per correlation id that links several incidents; sizes and span, no member lists."""
    return (
        incidents.groupBy("correlation_id")
        .agg(
            F.count("*").alias("incidents"),
            F.min("created_at").alias("first_created"),
            F.max("created_at").alias("last_created"),
            F.min_by("alert_id", F.struct("created_at", "alert_id")).alias("first_alert_id"),
        )
        .filter(F.col("incidents") > 1)
    )


def with_related(incidents: DataFrame) -> DataFrame:
    """Number of related alerts and the neighbours in creation order, instead of all pairs of a group."""
    groups = correlation_groups(incidents).select("correlation_id", F.col("incidents").alias("_n"))
    out = incidents.join(groups, "correlation_id", "left").withColumn(
        "related_count", F.coalesce(F.col("_n") - 1, F.lit(0)).cast("bigint")
    ).drop("_n")
    seen = previous_values(
        out.withColumn("_own", F.col("alert_id")), "correlation_id", ["created_at", "alert_id"], ["_own"]
    )
    return seen.drop("_own", "is_first").withColumnRenamed("previous__own", "previous_related")
