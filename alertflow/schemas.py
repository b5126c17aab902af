"""Record schemas and enumerations. Canonical names are snake_case."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the log, alert and incident records.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
STATUSES = ("OPEN", "ACKNOWLEDGED", "INVESTIGATING", "RESOLVED", "CLOSED")
INCIDENT_EVENTS = (
    "CREATED", "ACKNOWLEDGED", "INVESTIGATING", "ESCALATED",
    "RESOLVED", "CLOSED", "REOPENED", "COMMENTED", "ASSIGNED",
)
ANOMALY_TYPES = (
    "error_spike", "unusual_pattern", "performance_degradation", "security_threat",
    "resource_exhaustion", "correlation_anomaly", "unknown",
)
ACTION_TYPES = (
    "POD_RESTART", "SERVICE_SCALE_UP", "SERVICE_SCALE_DOWN", "CIRCUIT_BREAKER_OPEN",
    "CIRCUIT_BREAKER_CLOSE", "HEALTH_CHECK", "ROLLBACK",
)
ACTION_STATUSES = ("PENDING", "EXECUTING", "COMPLETED", "FAILED", "SKIPPED", "DRY_RUN")


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string,string>": T.MapType(T.StringType(), T.StringType()),
    "map<string,double>": T.MapType(T.StringType(), T.DoubleType()),
    "map<string,bigint>": T.MapType(T.StringType(), T.LongType()),
}


def _struct(columns: str) -> T.StructType:
    """``name type`` pairs to a struct; usable before a session exists."""
    pairs = (c.split(" ") for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LOG_EVENT = _struct(
    "id string, event_ts timestamp_ntz, service_name string, hostname string, pod_name string, level string, "
    "message string, exception string, stack_trace string, thread string, logger string, method string, "
    "line_number int, user_id string, session_id string, request_id string, http_method string, http_status int, "
    "endpoint string, duration_ms double, metadata map<string,string>, trace_id string, span_id string"
)

# Wire names of one record as producers send it: the collector form plus the
# optional fields of the scoring form.
RAW_LOG = _struct(
    "id string, serviceName string, hostname string, podName string, level string, message string, "
    "stackTrace string, timestamp timestamp_ntz, metadata map<string,string>, traceId string, spanId string, "
    "exception string, thread string, logger string, method string, line_number int, user_id string, "
    "session_id string, request_id string, http_method string, http_status int, endpoint string, duration_ms double"
)

SCORED_LOG = T.StructType(
    LOG_EVENT.fields
    + _struct(
        "anomaly_score double, anomaly_reasons array<string>, feature_scores map<string,double>, "
        "is_anomaly boolean, anomaly_type string, scored_at timestamp_ntz"
    ).fields
)

ALERT = _struct(
    "alert_id string, correlation_id string, source_log_id string, service_name string, hostname string, "
    "pod_name string, severity string, status string, title string, description string, anomaly_score double, "
    "anomaly_reasons array<string>, anomaly_type string, created_at timestamp_ntz, updated_at timestamp_ntz, "
    "resolved_at timestamp_ntz, metadata map<string,string>, tags array<string>, assignee string, "
    "escalation_level int, suppress_duplicates boolean, fingerprint string"
)

INCIDENT = T.StructType(
    ALERT.fields
    + _struct(
        "time_to_acknowledge bigint, time_to_resolve bigint, escalation_count int, notifications_sent int, "
        "automated_actions_triggered int, business_impact double, affected_services array<string>, "
        "impact_score int, expires_at timestamp_ntz"
    ).fields
)

INCIDENT_EVENT = _struct(
    "alert_id string, event_id string, event_type string, description string, user_id string, "
    "event_time timestamp_ntz, ord int"
)

INCIDENT_SUMMARY = _struct(
    "window_start timestamp_ntz, window_end timestamp_ntz, service_name string, total_incidents bigint, "
    "critical_incidents bigint, high_incidents bigint, medium_incidents bigint, low_incidents bigint, "
    "info_incidents bigint, resolved_incidents bigint, open_incidents bigint, average_anomaly_score double, "
    "average_time_to_resolve double, average_time_to_acknowledge double, incidents_by_type map<string,bigint>, "
    "incidents_by_host map<string,bigint>, created_at timestamp_ntz, expires_at timestamp_ntz"
)
