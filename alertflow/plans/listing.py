"""Incident look-ups, listings, paging, search and summary queries."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from alertflow.operators import dashboards, postings
from alertflow.operators import incident_queries as iq
from alertflow.plans.lifecycle import INCIDENTS, folded
from alertflow.plans.registry import Plans
from alertflow.plans.tables import sql
from alertflow.session import new_folder

plans = Plans()
A, B = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12, 12)
TA, TB = "TIMESTAMP '2024-01-10 00:00:00'", "TIMESTAMP '2024-01-12 12:00:00'"
SHOWN = ("alert_id", "service_name", "status", "severity", "created_at")


def listed(name, where, fn):
    plans.add(name, sql(*INCIDENTS, f"SELECT {', '.join(SHOWN)} FROM incidents WHERE {where}"))(
        lambda spark, d: fn(folded(spark, d)).select(*SHOWN)
    )


listed("incident_by_alert_id", "alert_id = 'ALERT-' || upper(substr(sha256('log-4'), 1, 16))",
       lambda i: iq.by_alert(i, "ALERT-" + hashlib.sha256(b"log-4").hexdigest()[:16].upper()))
listed("incidents_by_service", "service_name = 'order-service'", lambda i: iq.by_fields(i, service_name="order-service"))
listed("incidents_by_status", "status = 'RESOLVED'", lambda i: iq.by_fields(i, status="RESOLVED"))
listed("incidents_by_severity", "severity = 'HIGH'", lambda i: iq.by_fields(i, severity="HIGH"))
listed("incidents_by_service_status", "service_name = 'auth-service' AND status = 'OPEN'",
       lambda i: iq.by_fields(i, service_name="auth-service", status="OPEN"))
listed("incidents_created_between", f"created_at > {TA} AND created_at < {TB}", lambda i: iq.created_between(i, A, B))
listed("incidents_created_between_service", f"created_at > {TA} AND created_at < {TB} AND service_name = 'auth-service'",
       lambda i: iq.created_between(i, A, B, "auth-service"))
listed("incidents_service_severity_range", f"created_at >= {TA} AND created_at < {TB} AND service_name = 'auth-service' AND severity = 'CRITICAL'",
       lambda i: iq.created_in(i, A, B, service_name="auth-service", severity="CRITICAL"))
listed("incidents_severity_range", f"created_at >= {TA} AND created_at < {TB} AND severity = 'LOW'",
       lambda i: iq.created_in(i, A, B, severity="LOW"))
listed("incidents_score_at_least", "anomaly_score >= 0.7::DOUBLE", lambda i: iq.score_at_least(i, 0.7))
listed("incidents_assigned", "assignee = 'user-2' AND status IN ('ACKNOWLEDGED', 'INVESTIGATING')",
       lambda i: iq.assigned_to(i, "user-2", ["ACKNOWLEDGED", "INVESTIGATING"]))
listed("incidents_closed_before", f"status = 'CLOSED' AND created_at < {TA}", lambda i: iq.closed_before(i, A))
listed("listing_service_range_beats_severity", f"service_name = 'auth-service' AND created_at > {TA} AND created_at < {TB}",
       lambda i: iq.find_incidents(i, service="auth-service", severity="LOW", start=A, end=B))
listed("listing_service_status_ignores_range", "service_name = 'auth-service' AND status = 'CLOSED'",
       lambda i: iq.find_incidents(i, service="auth-service", status="CLOSED", start=A, end=B))
listed("listing_status_beats_severity", "status = 'OPEN'", lambda i: iq.find_incidents(i, status="OPEN", severity="LOW"))
listed("listing_all_filters", f"status = 'OPEN' AND severity = 'LOW' AND created_at > {TA} AND created_at < {TB}",
       lambda i: iq.find_incidents(i, status="OPEN", severity="LOW", start=A, end=B, mode="all"))
NEW = "1 = 1 ORDER BY created_at DESC, alert_id"
listed("incidents_page", f"{NEW} LIMIT 20 OFFSET 60", lambda i: iq.page(i, 3, 20))
listed("incidents_page_after", f"created_at < {TA} ORDER BY created_at DESC, alert_id LIMIT 20",
       lambda i: iq.page(i, size=20, after=(A, "~")))
listed("incidents_newest", f"{NEW} LIMIT 10", iq.newest)


@plans.add("incident_total", sql(*INCIDENTS, "SELECT count(*) AS total_elements FROM incidents"))
def _(spark, d):
    return iq.total(folded(spark, d))


@plans.add("incident_count_in_range", sql(*INCIDENTS, f"""SELECT count(*) AS incidents FROM incidents
  WHERE service_name = 'payment-service' AND created_at >= {TA} AND created_at < {TB}"""))
def _(spark, d):
    return iq.count_in(folded(spark, d), "payment-service", A, B)


HAY = "regexp_split_to_array(lower(title || ' ' || description || ' ' || array_to_string(anomaly_reasons, ' ')), '[^\\p{L}\\p{N}_]+')"


def searched(name, where, fn):
    plans.add(name, sql(*INCIDENTS, f"t AS (SELECT *, {HAY} AS hay, lower(description) AS low, lower(title) AS lot FROM incidents)",
                        f"SELECT alert_id, title FROM t WHERE {where}"))(
        lambda spark, d: fn(folded(spark, d)).select("alert_id", "title")
    )


searched("text_search_any_word", "list_has_any(hay, ['timeout', 'authentication'])", lambda i: iq.text_search(i, "Timeout authentication"))
searched("text_search_phrase_without_word",
         "contains(low, 'authentication failed') AND NOT list_has_any(hay, ['order'])",
         lambda i: iq.text_search(i, '"Authentication failed" -order'))
searched("text_search_limited", "list_has_any(hay, ['timeout']) ORDER BY created_at DESC, alert_id LIMIT 500",
         lambda i: iq.text_search(i, "timeout", limit=500))


def posted(name, like, query, **kw):
    """The same answer as the scan, from a posting table written for it."""

    @plans.add(name, plans.sql[like])
    def _(spark, d):
        path = new_folder(spark, "postings")
        incidents = folded(spark, d)
        postings.write_postings(incidents, path)
        return postings.search(incidents, postings.Postings(spark, path), query, **kw).select("alert_id", "title")


posted("posting_search_any_word", "text_search_any_word", "Timeout authentication")
posted("posting_search_phrase_without_word", "text_search_phrase_without_word", '"Authentication failed" -order')
posted("posting_search_limited", "text_search_limited", "timeout", limit=500)


# -- summaries ---------------------------------------------------------------

SUMMARIES = """summaries AS (SELECT service_name, time_bucket(INTERVAL 15 MINUTE, created_at, TIMESTAMP '2000-01-01') AS window_start,
  time_bucket(INTERVAL 15 MINUTE, created_at, TIMESTAMP '2000-01-01') + INTERVAL 15 MINUTE AS window_end, count(*) AS total_incidents,
  count(*) FILTER (severity = 'CRITICAL') AS critical_incidents, count(*) FILTER (severity = 'HIGH') AS high_incidents,
  count(*) FILTER (severity = 'MEDIUM') AS medium_incidents, count(*) FILTER (severity = 'LOW') AS low_incidents,
  count(*) FILTER (severity = 'INFO') AS info_incidents,
  count(*) FILTER (status IN ('RESOLVED', 'CLOSED')) AS resolved_incidents, count(*) FILTER (status NOT IN ('RESOLVED', 'CLOSED')) AS open_incidents,
  avg(anomaly_score) AS average_anomaly_score, coalesce(avg(time_to_resolve) / 60000, 0) AS average_time_to_resolve,
  coalesce(avg(time_to_acknowledge) / 60000, 0) AS average_time_to_acknowledge FROM incidents GROUP BY ALL)"""
BASIC = ("service_name", "window_start", "window_end", "total_incidents", "critical_incidents")


def summaries(spark, d):
    return dashboards.incident_summary(folded(spark, d))


def summarised(name, where, fn, cols=BASIC):
    plans.add(name, sql(*INCIDENTS, SUMMARIES, f"SELECT {', '.join(cols)} FROM summaries WHERE {where}"))(
        lambda spark, d: fn(summaries(spark, d)).select(*cols)
    )


summarised("summary_of_window", "service_name = 'order-service' AND window_start = TIMESTAMP '2024-01-01 00:00:00' AND window_end = TIMESTAMP '2024-01-01 00:15:00'",
           lambda s: iq.summary_of_window(s, "order-service", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 15)))
summarised("summaries_between_service", f"service_name = 'order-service' AND window_start > {TA} AND window_start < {TB}",
           lambda s: iq.summaries_between(s, A, B, "order-service"))
summarised("summaries_between", f"window_start > {TA} AND window_start < {TB}", lambda s: iq.summaries_between(s, A, B))
summarised("summaries_in_range", f"window_start >= {TA} AND window_start < {TB}", lambda s: iq.summaries_in(s, A, B))
summarised("summaries_from", f"service_name = 'auth-service' AND window_start >= {TB}",
           lambda s: iq.summaries_from(s, "auth-service", B))
summarised("summaries_newest_per_service", "1 = 1 QUALIFY row_number() OVER (PARTITION BY service_name ORDER BY window_start DESC) <= 10",
           lambda s: iq.newest_summaries(s))
summarised("summary_columns", f"window_start >= {TA} AND window_start < {TB}",
           lambda s: iq.summary_counts(s, A, B), ("service_name", "total_incidents", "critical_incidents"))
