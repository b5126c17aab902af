"""Suppression and cap queries. The SQL walks the rows one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.operators import responder, suppress
from alertflow.plans.alerting import BASE, build
from alertflow.plans.registry import Plans
from alertflow.plans.tables import sql

plans = Plans()


def walk_sql(source: str, key: str, fp: str, window_s: int, cap: int, out: str = "decided") -> str:
    """Decision per row of ``source`` (alert_id, created_at): state is carried row by row."""
    return f"""numbered_{out} AS (SELECT alert_id, {key} AS k, {fp} AS f, created_at AS t,
  row_number() OVER (PARTITION BY {key} ORDER BY created_at, alert_id) AS rn FROM {source}),
steps_{out} AS (
  SELECT DISTINCT k, 0::BIGINT AS rn, MAP {{}}::MAP(VARCHAR, TIMESTAMP) AS seen, -1::BIGINT AS slot, 0 AS cnt,
    NULL::VARCHAR AS alert_id, NULL::VARCHAR AS decision FROM numbered_{out}
  UNION ALL
  SELECT k, rn, CASE WHEN d = 'emitted' THEN map_concat(seen, MAP {{f: t}}) ELSE seen END, slot,
    cnt + (d = 'emitted')::INT, alert_id, d
  FROM (SELECT *, CASE WHEN seen[f] IS NOT NULL AND t < seen[f] + to_seconds({window_s}) THEN 'suppressed'
      WHEN cnt >= {cap} THEN 'limited' ELSE 'emitted' END AS d
    FROM (SELECT n.k, n.rn, n.f, n.t, n.alert_id, s.seen, epoch_us(n.t) // 3600000000 AS slot,
        CASE WHEN epoch_us(n.t) // 3600000000 = s.slot THEN s.cnt ELSE 0 END AS cnt
      FROM steps_{out} s JOIN numbered_{out} n ON n.k = s.k AND n.rn = s.rn + 1))),
{out} AS (SELECT alert_id, decision FROM steps_{out} WHERE alert_id IS NOT NULL)"""


def chain_sql(window_s: int) -> str:
    """Emitted alerts without a cap: the first of a fingerprint, then the first after each window."""
    return f"""firsts AS (SELECT fingerprint AS f, created_at AS t, min(alert_id) AS alert_id FROM alerts GROUP BY ALL),
chain AS (SELECT f, min(t) AS t FROM firsts GROUP BY f
  UNION ALL SELECT c.f, min(a.t) FROM chain c JOIN firsts a ON a.f = c.f AND a.t >= c.t + to_seconds({window_s}) GROUP BY c.f),
emitted AS (SELECT a.alert_id, a.f AS fingerprint, a.t AS created_at FROM firsts a JOIN chain c ON a.f = c.f AND a.t = c.t)"""


@plans.add("suppress_duplicates", sql(*BASE, chain_sql(300), "SELECT * FROM emitted"))
def _(spark, d):
    return suppress.suppress_duplicates(build(spark, d)).select("alert_id", "fingerprint", "created_at")


@plans.add("suppression_without_cap_decisions", sql(*BASE, chain_sql(300), """SELECT a.alert_id,
  CASE WHEN e.alert_id IS NULL THEN 'suppressed' ELSE 'emitted' END AS decision FROM alerts a LEFT JOIN emitted e USING (alert_id)"""))
def _(spark, d):
    return suppress.label_alerts(build(spark, d), 300, None).select("alert_id", "decision")


@plans.add("suppress_duplicates_long_window", sql(*BASE, chain_sql(7200), "SELECT * FROM emitted"))
def _(spark, d):
    return suppress.suppress_duplicates(build(spark, d), 7200).select("alert_id", "fingerprint", "created_at")


@plans.add("cap_per_service", sql(*BASE, walk_sql("alerts", "service_name", "fingerprint", 300, 10),
                                  "SELECT alert_id FROM decided WHERE decision = 'emitted'"))
def _(spark, d):
    return suppress.cap_per_service(build(spark, d)).select("alert_id")


@plans.add("suppression_decisions", sql(*BASE, walk_sql("alerts", "service_name", "fingerprint", 3600, 2),
                                        "SELECT alert_id, decision FROM decided"))
def _(spark, d):
    return suppress.label_alerts(build(spark, d), 3600, 2).select("alert_id", "decision")


@plans.add("suppression_cache", sql(*BASE, chain_sql(300), """SELECT fingerprint, max(created_at) AS last_ts FROM emitted
  GROUP BY 1 HAVING max(created_at) + to_seconds(300) >= TIMESTAMP '2024-01-30 12:00:00'"""))
def _(spark, d):
    emitted = suppress.suppress_duplicates(build(spark, d))
    last = emitted.groupBy("fingerprint").agg(F.max("created_at").alias("last_ts"))
    return suppress.expire_suppression(last, F.to_timestamp_ntz(F.lit("2024-01-30 12:00:00")))


def late_corrections(name: str, key: str, window_s: int, cap: int | None) -> None:
    """Every seventh alert comes late; the corrections are exactly where both answers differ."""
    many = 10**9 if cap is None else cap

    @plans.add(name, sql(*BASE, "early AS (SELECT * FROM alerts WHERE event_id % 7 <> 3)",
        walk_sql("early", key, "fingerprint", window_s, many, "given"), walk_sql("alerts", key, "fingerprint", window_s, many, "wanted"),
        """SELECT w.alert_id, g.decision AS previous_decision, w.decision FROM wanted w LEFT JOIN given g USING (alert_id)
  WHERE w.decision IS DISTINCT FROM g.decision"""))
    def _(spark, d):
        alerts = build(spark, d)
        early = alerts.filter(F.substring("source_log_id", 5, 20).cast("bigint") % 7 != 3)
        return suppress.corrections(alerts, suppress.label_alerts(early, window_s, cap), window_s, cap)


late_corrections("late_alert_corrections", "fingerprint", 7200, None)
late_corrections("late_alert_corrections_capped", "service_name", 300, 10)


PLANNED = """planned AS (SELECT alert_id, service_name, created_at, CASE WHEN severity = 'CRITICAL' THEN 'POD_RESTART' ELSE 'SERVICE_SCALE_UP' END AS action_type
  FROM alerts WHERE regexp_full_match(service_name, 'order-service.*|payment-service.*|user-service.*')
  AND ((severity = 'CRITICAL' AND anomaly_score >= 0.9::DOUBLE) OR (severity = 'HIGH' AND anomaly_score >= 0.7::DOUBLE)))"""


def planned(spark, d):
    return responder.plan_actions(build(spark, d))


@plans.add("action_cooldown", sql(*BASE, PLANNED, "restarts AS (SELECT * FROM planned WHERE action_type = 'POD_RESTART')",
    "grown AS (SELECT * FROM planned WHERE action_type = 'SERVICE_SCALE_UP')",
    walk_sql("restarts", "service_name", "service_name", 900, 3, "kept_restarts"),
    walk_sql("grown", "service_name", "service_name", 600, 10, "kept_grown"),
    """SELECT alert_id, 'POD_RESTART' AS action_type FROM kept_restarts WHERE decision = 'emitted'
  UNION ALL SELECT alert_id, 'SERVICE_SCALE_UP' FROM kept_grown WHERE decision = 'emitted'"""))
def _(spark, d):
    return responder.limit_all(planned(spark, d)).select("alert_id", "action_type")
