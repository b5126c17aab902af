"""Deliveries as tables: channel fan-out, rendered texts, retry policy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.functions import rules

# Message templates.
SUBJECT = "[{{ severity }}] Alert: {{ title }}"
CHAT_MESSAGE = (
    "\U0001F6A8 *{{ severity }} Alert*\n"
    "*Service:* {{ serviceName }}\n"
    "*Description:* {{ description }}\n"
    "*Score:* {{ anomalyScore }}\n"
    "*Time:* {{ createdAt }}\n"
)
HTML_HEAD = "<html><body><h2>Alert Notification</h2><table border='1' cellpadding='5' cellspacing='0'>"
HTML_ROW = ("<tr><td><b>{}:</b></td><td>", "</td></tr>")
HTML_TAIL = "</table></body></html>"
CHAT_USER = "alertflow"
CHAT_ICON = ":warning:"
# Channel settings when nothing else is given.
CHANNELS = (
    {"channel": "EMAIL", "enabled": True, "target": "ops@example.com"},
    {"channel": "SLACK", "enabled": False, "target": "#alerts"},
)
# Delivery retries and back-off bounds in seconds.
MAX_ATTEMPTS, BACKOFF_FIRST_S, BACKOFF_MAX_S = 3, 1, 5


def score_text() -> Column:
    return F.format_string("%.3f", F.col("anomaly_score"))


def iso_created() -> Column:
    """ISO local time without trailing zeros of the fraction."""
    whole = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format("created_at", ".SSSSSS"), r"\.?0+$", "")
    return F.concat(whole, fraction)


def java_created() -> Column:
    """Local time as Java prints it: no seconds when they are zero, else the fraction in groups of three digits."""
    us = F.date_format("created_at", "SSSSSS")
    seconds = F.date_format("created_at", ":ss")
    tail = (
        F.when((us == "000000") & (seconds == ":00"), F.lit(""))
        .when(us == "000000", seconds)
        .when(F.endswith(us, F.lit("000")), F.concat(seconds, F.lit("."), F.substring(us, 1, 3)))
        .otherwise(F.concat(seconds, F.lit("."), us))
    )
    return F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm"), tail)


def recipients(addresses: Column) -> Column:
    return F.filter(F.transform(F.split(addresses, ","), lambda a: F.trim(a)), lambda a: a != "")


def subject(text: str = SUBJECT) -> Column:
    return rules.template(
        text, {"severity": F.col("severity"), "title": F.col("title"), "serviceName": F.col("service_name")}
    )


def chat_message(text: str = CHAT_MESSAGE) -> Column:
    return rules.template(
        text,
        {
            "severity": F.col("severity"),
            "serviceName": F.col("service_name"),
            "title": F.col("title"),
            "description": F.col("description"),
            "anomalyScore": score_text(),
            "createdAt": iso_created(),
        },
    )


def html_body() -> Column:
    """Two-column table; host and pod rows only where known."""

    def row(label: str, value: Column) -> Column:
        return F.concat(F.lit(HTML_ROW[0].format(label)), rules.text_or_null(value), F.lit(HTML_ROW[1]))

    def optional(label: str, col: str) -> Column:
        return F.when(F.col(col).isNotNull(), row(label, F.col(col))).otherwise(F.lit(""))

    shown = {
        "Alert ID": F.col("alert_id"),
        "Service": F.col("service_name"),
        "Severity": F.col("severity"),
        "Title": F.col("title"),
        "Description": F.col("description"),
        "Anomaly Score": score_text(),
        "Time": java_created(),
    }
    return F.concat(
        F.lit(HTML_HEAD),
        *[row(k, v) for k, v in shown.items()],
        optional("Host", "hostname"),
        optional("Pod", "pod_name"),
        F.lit(HTML_TAIL),
    )


def chat_payload(channel: str | None = "#alerts", username: str = CHAT_USER) -> Column:
    """Structured chat message as JSON, sent under ``username``."""

    def field(title: str, value: Column) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(True).alias("short"))

    text = chat_message()
    attachment = F.struct(
        rules.severity_colour(F.col("severity")).alias("color"),
        text.alias("text"),
        text.alias("fallback"),
        F.concat(F.lit("Alert: "), F.col("title")).alias("title"),
        F.lit("").alias("title_link"),
        F.array(
            field("Alert ID", F.col("alert_id")),
            field("Service", F.col("service_name")),
            field("Severity", F.col("severity")),
            field("Score", score_text()),
        ).alias("fields"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', created_at)").alias("timestamp"),
    )
    head = [F.lit(channel).alias("channel")] if channel and channel.strip() else []
    return F.to_json(
        F.struct(
            *head,
            F.lit(username).alias("username"),
            F.lit(CHAT_ICON).alias("icon_emoji"),
            F.array(attachment).alias("attachments"),
        )
    )


def fan_out_channels(alerts: DataFrame, channels: Sequence[Mapping] = CHANNELS) -> DataFrame:
    """One outbox row per alert and enabled channel, keyed (alert_id, channel).

    The channel list is configuration, so it is exploded from a literal and the
    alerts are not shuffled.
    """
    on = [c for c in channels if c["enabled"]]
    if not on:
        none = F.array().cast("array<struct<channel:string,target:string>>")
        return alerts.withColumn("_c", F.explode(none)).select(*alerts.columns, "_c.*")
    items = F.array(
        *[F.struct(F.lit(c["channel"]).alias("channel"), F.lit(c["target"]).alias("target")) for c in on]
    )
    return alerts.withColumn("_c", F.explode(items)).select(*alerts.columns, "_c.*")


def build_outbox(deliveries: DataFrame, channels: Sequence[Mapping] = CHANNELS) -> DataFrame:
    """Rendered messages, once per (alert, channel) even where an alert sits in two queues."""
    mail = F.col("channel") == "EMAIL"
    # keys first, so that no rendered text is shuffled
    rows = fan_out_channels(deliveries.dropDuplicates(["alert_id"]), channels).withColumns(
        {
            "subject": F.when(mail, subject()),
            "body": F.when(mail, html_body()).otherwise(chat_message()),
            "status": F.lit("PENDING"),
            "attempts": F.lit(0),
            "next_attempt_at": F.col("created_at"),
        }
    )
    return rows


def after_attempt(
    outbox: DataFrame,
    outcomes: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    first_s: int = BACKOFF_FIRST_S,
    max_s: int = BACKOFF_MAX_S,
) -> DataFrame:
    """Next outbox state from (alert_id, channel, queue, delivered, attempted_at).

    Normal queues drop a message after its last retry; critical ones keep it queued.
    Of several outcomes of one message (an alert may sit in two queues) a delivery
    wins, then a critical queue, then the latest attempt: one attempt, one row.
    """
    urgent = (F.col("queue") == "critical-alerts").cast("int")
    best = F.max_by(
        F.struct(F.col("queue").alias("_queue"), "delivered", "attempted_at"),
        F.struct(F.col("delivered"), urgent, F.col("attempted_at")),
    )
    once_each = outcomes.groupBy("alert_id", "channel").agg(best.alias("_o")).select("alert_id", "channel", "_o.*")
    joined = outbox.join(once_each, ["alert_id", "channel"], "left")
    return joined.select(
        *[c for c in outbox.columns if c not in ("status", "attempts", "next_attempt_at")],
        *retry_state(max_attempts, first_s, max_s),
    )


def retry_state(max_attempts: int, first_s: int, max_s: int) -> list[Column]:
    was_tried = F.col("delivered").isNotNull()
    attempts = F.col("attempts") + was_tried.cast("int")
    spent = attempts >= max_attempts
    keep = F.col("_queue") == "critical-alerts"
    wait = F.least(F.lit(float(first_s)) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(max_s))).cast("int")
    status = (
        F.when(~was_tried, F.col("status"))
        .when(F.col("delivered"), F.lit("SENT"))
        .when(spent & ~keep, F.lit("FAILED"))
        .otherwise(F.lit("RETRY"))
    )
    due = F.when(~was_tried, F.col("next_attempt_at")).when(
        ~F.col("delivered") & (keep | ~spent),
        F.timestamp_add("SECOND", wait, F.col("attempted_at")),
    )
    return [status.alias("status"), attempts.alias("attempts"), due.alias("next_attempt_at")]
