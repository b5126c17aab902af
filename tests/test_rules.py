"""Boundary cases of scoring, alert fields, text functions, listings and outbox texts."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from alertflow.functions import rules, text
from alertflow.operators import alerts, dashboards, features, incident_queries, incidents, outbox, responder, scoring
from alertflow.schemas import LOG_EVENT
from alertflow.sources import intake

T0 = dt.datetime(2024, 1, 1, 12)


def log(spark, **kw):
    base = {"id": "a", "event_ts": T0, "service_name": "s", "hostname": "h", "level": "INFO", "message": "m"}
    rows = kw.pop("rows", [{}])
    return spark.createDataFrame(
        [tuple({**base, **kw, **r}.get(f.name) for f in LOG_EVENT.fields) for r in rows], LOG_EVENT
    )


def one(df, col):
    return df.select(col).first()[0]


@pytest.mark.parametrize("score,want", [
    (0.1, "INFO"), (0.29999, "INFO"), (0.3, "LOW"), (0.5, "MEDIUM"), (0.7, "HIGH"), (0.89999, "HIGH"), (0.9, "CRITICAL"),
])
def test_severity_bounds(spark, score, want):
    assert spark.range(1).select(rules.severity(F.lit(score))).first()[0] == want


def test_thresholds_are_strict(spark):
    rows = scoring.score_default(log(spark, level="ERROR"), threshold=0.7)
    assert rows.select("anomaly_score", "is_anomaly").first() == (0.7, False)
    low = scoring.score_default(log(spark, level="INFO"))
    assert alerts.alert_candidates(low, 0.1).count() == 0
    assert alerts.alert_candidates(scoring.score_default(log(spark, level="WARN"))).count() == 1


def test_slow_means_more_than_5000(spark):
    rows = log(spark, rows=[{"id": "x", "duration_ms": 5000.0}, {"id": "y", "duration_ms": 5000.5}])
    got = {r.id: r.anomaly_type for r in scoring.classify_anomaly(rows).collect()}
    assert got == {"x": "unknown", "y": "performance_degradation"}


def test_heuristic_details(spark):
    full = scoring.score_heuristic(
        log(spark, level="ERROR", exception="E", http_status=500, duration_ms=6000.0)
    ).first()
    assert full.anomaly_score == 1.0 and full.is_anomaly and full.anomaly_type == "error_spike"
    assert full.anomaly_reasons == ["Error level log", "Exception present", "Server error: 500", "High response time"]
    assert full.recommendations[0].startswith("HIGH PRIORITY")
    quiet = scoring.score_heuristic(log(spark, level="WARN", exception="")).first()
    assert (quiet.anomaly_score, quiet.anomaly_type, quiet.anomaly_reasons) == (0.4, None, [])


def test_later_rule_wins(spark):
    rows = log(spark, rows=[
        {"id": "auth", "level": "ERROR", "message": "login failed", "http_status": 500},
        {"id": "client", "level": "ERROR", "message": "x", "http_status": 404, "duration_ms": 9000.0},
        {"id": "fatal", "level": "FATAL", "message": "password leak"},
    ])
    got = {r.id: r.anomaly_type for r in scoring.classify_anomaly(rows).collect()}
    assert got == {"auth": "security_threat", "client": "security_threat", "fatal": "unusual_pattern"}


@pytest.mark.parametrize("value,want", [(5000.5, "5000.5"), (1e7, "10000000.0"), (12345678.5, "12345678.5"), (6000.0, "6000.0")])
def test_plain_double(spark, value, want):
    assert spark.range(1).select(rules.plain_double(F.lit(value))).first()[0] == want


def test_ensemble_without_scores(spark):
    df = spark.createDataFrame([("a", None, None, None)], "id string, isolation_forest double, one_class_svm double, local_outlier_factor double")
    assert scoring.ensemble(df).select("anomaly_score", "confidence").first() == (0.5, 0.0)
    long = df.unpivot("id", list(scoring.MODELS), "model", "score")
    assert one(scoring.ensemble_long(long), "anomaly_score") == 0.5


def test_alert_texts_with_nulls(spark):
    scored = scoring.score_heuristic(log(spark, level="WARN", hostname=None, pod_name="p1", metadata={"traceId": "old", "x": "1"}, trace_id="new"))
    a = alerts.build_alerts(scored).first()
    assert a.title == "LOW Alert: null anomaly detected in s"
    assert "Host: null\nPod: p1\n" in a.description
    assert a.tags == ["service:s", "level:warn", "anomaly_type:null", "pod:p1"]
    assert a.metadata["traceId"] == "new" and a.metadata["x"] == "1" and a.metadata["spanId"] is None
    import base64
    import hashlib

    assert a.fingerprint == base64.b64encode(hashlib.md5(b"snullnullWARN").digest()).decode()


@pytest.mark.parametrize("message", ["", "aab", "a😀é", "日本語 日本", "x" * 50, "line\nbreak\nline"])
def test_entropy_and_length(spark, message):
    df = spark.createDataFrame([(message,)], "m string")
    n = len(message)
    want = -sum(c / n * math.log2(c / n) for c in (message.count(x) for x in set(message))) if n else 0.0
    got = df.select(text.entropy(F.col("m")), F.length("m")).first()
    assert got[0] == pytest.approx(want, abs=1e-9) and got[1] == n


def test_clean_text(spark):
    raw = "from 10.0.0.1  mail a.b@c.org\tat http://x.y/z?q=1 id 12345678-aaaa-bbbb-cccc-1234567890ab took 15 ms "
    df = spark.createDataFrame([(raw,), (None,), ("a" * 10_050,)], "m string")
    got = [r[0] for r in df.select(text.clean_text(F.col("m"))).collect()]
    # the range of url characters has no question mark and the rest is masked later
    assert got[0].startswith("from <IP_ADDRESS> mail <EMAIL> at <URL>") and got[0].endswith("id <UUID> took <NUMBER> ms")
    assert got[1] == "" and len(got[2]) == 10_050


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("The Café is a Naïve place",), ("x",), ("",)], "m string")
    words = [r[0] for r in df.select(text.tokens(F.col("m"), ["the", "is"])).collect()]
    assert words == [["cafe", "naive", "place"], [], []]
    grams = df.select(text.ngrams(text.tokens(F.col("m")), 2)).first()[0]
    assert grams == ["the cafe", "cafe is", "is naive", "naive place"]


def test_pattern_counts(spark):
    message = "10.0.0.1 java.lang.Error error at a.B.c(B.java:3) at x.Y$z(Y.java:9)"
    df = log(spark, message=message)
    got = df.select(*[c.alias(n) for n, c in features.pattern_features().items()]).first()
    assert got.pattern_ip_address_count == 1 and got.pattern_stack_trace_count == 2 and got.pattern_exception_count == 2


def test_unseen_and_missing_categories(spark):
    fit = features.fit_categories(log(spark, rows=[{"service_name": "a"}, {"service_name": "b"}]))
    out = features.encode_labels(log(spark, service_name="zz", logger=None), fit).first()
    assert out.service_name_encoded == -1 and out.logger_encoded == 0
    hot = features.one_hot(features.encode_labels(log(spark, service_name="zz"), fit))
    assert not [r for r in hot.collect() if r.feature.startswith("service_name")]


def test_constant_column_scales_to_zero(spark):
    df = log(spark, rows=[{"id": "a", "duration_ms": 5.0}, {"id": "b", "duration_ms": 5.0}])
    scaled = features.scaled(features.fit_statistics(df))["duration_ms_scaled"]
    assert {r[0] for r in df.select(scaled).collect()} == {0.0}


def incident_rows(spark):
    rows = [
        ("a1", "s1", "OPEN", "LOW", dt.datetime(2024, 1, 1), "Disk full", "no space left", ["slow disk"]),
        ("a2", "s1", "CLOSED", "HIGH", dt.datetime(2024, 1, 2), "Login failed", "bad password for bob", []),
        ("a3", "s2", "OPEN", "HIGH", dt.datetime(2024, 1, 3), "Disk slow", "latency", None),
    ]
    return spark.createDataFrame(
        rows, "alert_id string, service_name string, status string, severity string, created_at timestamp_ntz, "
        "title string, description string, anomaly_reasons array<string>"
    )


def ids(df):
    return sorted(r.alert_id for r in df.collect())


def test_listing_precedence_and_ranges(spark):
    i = incident_rows(spark)
    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 3)
    find = incident_queries.find_incidents
    assert ids(find(i, "s1", "OPEN", "HIGH", a, b)) == ["a1"]
    assert ids(find(i, "s1", None, "LOW", a, b)) == ["a2"]  # range is open at both ends
    assert ids(find(i, None, "OPEN", "HIGH")) == ["a1", "a3"]
    assert ids(find(i, start=a)) == ["a1", "a2", "a3"]  # half a range is no filter
    assert ids(find(i, None, "OPEN", "HIGH", mode="all")) == ["a3"]
    assert ids(incident_queries.created_in(i, a, b)) == ["a1", "a2"]
    newest = incident_queries.newest(i, 2).collect()
    assert [r.alert_id for r in newest] == ["a3", "a2"]
    second = incident_queries.page(i, size=1, after=(newest[0].created_at, newest[0].alert_id)).collect()
    assert [r.alert_id for r in second] == ["a2"]


@pytest.mark.parametrize("query,want", [
    ("disk", ["a1", "a3"]), ("DISK password", ["a1", "a2", "a3"]), ("disk -latency", ["a1"]), ('"no space"', ["a1"]),
    ('"no space" password', ["a1"]), ("dis", []), ("", []),
])
def test_text_search(spark, query, want):
    assert ids(incident_queries.text_search(incident_rows(spark), query)) == want


def version(spark, rows):
    full = [
        ("a1", f"s", sev, st, asg, T0 + dt.timedelta(minutes=m), n, res)
        for n, (m, st, sev, asg, res) in enumerate(rows)
    ]
    v = spark.createDataFrame(
        full, "alert_id string, service_name string, severity string, status string, assignee string, "
        "version_ts timestamp_ntz, version_no bigint, resolved_at timestamp_ntz"
    )
    fixed = {c: F.lit(None).cast("string") for c in ("correlation_id", "source_log_id", "hostname", "pod_name", "title", "description", "anomaly_type", "fingerprint")}
    return v.withColumns({
        **fixed, "anomaly_score": F.lit(0.75), "anomaly_reasons": F.array().cast("array<string>"),
        "created_at": F.lit(T0), "updated_at": F.lit(T0), "metadata": F.create_map().cast("map<string,string>"),
        "tags": F.array().cast("array<string>"), "escalation_level": F.lit(0), "suppress_duplicates": F.lit(True),
    })


def test_incident_history(spark):
    v = version(spark, [
        (0, "OPEN", "HIGH", "ann", None), (5, "OPEN", "HIGH", None, None), (10, "RESOLVED", "HIGH", None, None),
        (20, "OPEN", "LOW", "ann", None), (30, "RESOLVED", "LOW", "bob", None), (3000, "RESOLVED", "LOW", "bob", None),
    ])
    for bucket in (60, 86_400):
        i = incidents.fold_incidents(v, bucket).first()
        assert i.resolved_at == T0 + dt.timedelta(minutes=10) and i.time_to_resolve == 600_000
        assert (i.status, i.severity, i.assignee) == ("RESOLVED", "LOW", "bob")
        assert i.updated_at == T0 + dt.timedelta(minutes=30) and i.reopen_count == 1 and i.escalation_count == 1
        assert i.impact_score == 75 + 37
        events = incidents.event_log(incidents.incident_events(v, bucket), "a1").collect()
        assert [e.event_type for e in events] == ["CREATED", "RESOLVED", "CREATED", "ESCALATED", "RESOLVED", "ASSIGNED"]
        assert len({e.event_id for e in events}) == 6


def test_resolution_known_at_creation_is_kept(spark):
    at = T0 - dt.timedelta(minutes=1)
    i = incidents.fold_incidents(version(spark, [(0, "OPEN", "LOW", None, at), (9, "RESOLVED", "LOW", None, None)])).first()
    assert i.resolved_at == at and i.time_to_resolve is None


def test_comments(spark):
    log_ = incidents.incident_events(version(spark, [(0, "OPEN", "LOW", None, None)]))
    said = spark.createDataFrame(
        [("a1", "ok", None, T0), ("a1", "  ", "u", T0), ("zz", "lost", "u", T0)],
        "alert_id string, comment string, user_id string, commented_at timestamp_ntz",
    )
    got = [(r.event_type, r.description, r.user_id) for r in incidents.event_log(incidents.add_comments(log_, said), "a1").collect()]
    assert got[0][0] == "CREATED" and got[1:] == [("COMMENTED", "ok", "anonymous")]


def test_health_bounds(spark):
    h = lambda n, c, s: spark.range(1).select(dashboards.health(F.lit(n), F.lit(c), F.lit(s))).first()[0]
    assert (h(0, 0, 0), h(9, 6, 0), h(9, 1, 1)) == (100.0, 0.0, 70.0)


def test_outbox_texts(spark):
    a = alerts.build_alerts(scoring.score_heuristic(log(spark, level="FATAL", message="x")))
    row = a.select(outbox.subject().alias("s"), outbox.chat_message().alias("c"), outbox.html_body().alias("h"), outbox.chat_payload().alias("p"),
                   outbox.recipients(F.lit(" a@b.c, ,d@e.f,")).alias("r")).first()
    assert row.s == "[CRITICAL] Alert: CRITICAL Alert: error_spike anomaly detected in s"
    assert "*Score:* 0.900\n*Time:* 2024-01-01T12:00:00\n" in row.c
    assert "<td><b>Host:</b></td><td>h</td>" in row.h and "Pod:" not in row.h
    import json

    p = json.loads(row.p)
    assert p["attachments"][0]["color"] == "#FF0000" and p["attachments"][0]["timestamp"] == 1704110400
    assert [f["title"] for f in p["attachments"][0]["fields"]] == ["Alert ID", "Service", "Severity", "Score"]
    assert row.r == ["a@b.c", "d@e.f"]
    assert outbox.fan_out_channels(a, [{"channel": "EMAIL", "enabled": False, "target": ""}]).count() == 0


def test_response_plan(spark):
    rows = [("a", "order-service", "CRITICAL", 0.95), ("b", "my-order-service", "CRITICAL", 0.95), ("c", "payment-service-eu", "HIGH", 0.7),
            ("d", "user-service", "HIGH", 0.65), ("e", "order-service", "LOW", 0.4)]
    df = spark.createDataFrame(rows, "alert_id string, service_name string, severity string, anomaly_score double")
    got = {r.alert_id: r.action_type for r in responder.plan_actions(df).collect()}
    assert got == {"a": "POD_RESTART", "c": "SERVICE_SCALE_UP"}
    n = lambda c, w: spark.range(1).select(responder.target_replicas(F.lit(c), F.lit(w))).first()[0]
    assert (n(2, 9), n(5, 40), n(3, 0)) == (6, 10, 1)


def test_bad_records(spark):
    rows = ['{"id":"a","level":"INFO","timestamp":"2024-01-01T00:00:00.5","metadata":{"a":{"b":1},"c":"d"}}', "nonsense", '{"level":"CRITICAL"}', '{"id":"n"}', None]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    good, bad = intake.split_malformed(intake.ingest_logs(df))
    g = good.first()
    assert g.event_ts == dt.datetime(2024, 1, 1, 0, 0, 0, 500_000) and g.metadata["c"] == "d" and '"b"' in g.metadata["a"]
    assert sorted(r.reject_reason for r in bad.collect()) == ["missing level", "not a valid record", "not a valid record", "unknown level CRITICAL"]
