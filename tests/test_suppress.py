"""Suppression and caps against a row-by-row loop."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from alertflow.operators import scoring, suppress
from alertflow.plans import tables

START = dt.datetime(2024, 1, 1)


def loop(rows, window_s, cap, reset_s=3600):
    """rows: (id, key, fingerprint, ts) -> {id: decision}, one row at a time."""
    last, counts, out = {}, {}, {}
    for i, k, f, t in sorted(rows, key=lambda r: (r[3], r[0])):
        slot = int((t - dt.datetime(1970, 1, 1)).total_seconds()) // reset_s
        if counts.get(k, (None, 0))[0] != slot:
            counts[k] = (slot, 0)
        if f in last and t < last[f] + dt.timedelta(seconds=window_s):
            out[i] = "suppressed"
        elif cap is not None and counts[k][1] >= cap:
            out[i] = "limited"
        else:
            out[i] = "emitted"
            last[f] = t
            counts[k] = (slot, counts[k][1] + 1)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "alert_id string, service_name string, fingerprint string, created_at timestamp_ntz")


def labels(df):
    return {r.alert_id: r.decision for r in df.select("alert_id", "decision").collect()}


@pytest.mark.parametrize("seed,n,span,window,cap,parts", [
    (1, 400, 20_000, 300, 2, 7),
    (2, 400, 4_000, 300, None, 5),
    (3, 500, 90_000, 3600, 2, 16),
    (4, 300, 3_000, 900, 1, 11),
    (5, 600, 40_000, 7200, 3, 13),
    (6, 200, 2_000, 0, 2, 4),
])
def test_matches_loop_with_a_hot_service(spark, seed, n, span, window, cap, parts):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        service = "hot" if rnd.random() < 0.6 else f"s{rnd.randrange(4)}"
        fp = f"{service}-{'a' if rnd.random() < 0.5 else rnd.randrange(4)}"
        at = START + dt.timedelta(seconds=rnd.randrange(span), microseconds=rnd.choice([0, 0, 250_000]))
        rows.append((f"id{i:05d}", service, fp, at))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = labels(suppress.label_alerts(frame(spark, rows), window, cap))
        emitted = suppress.emit(frame(spark, rows), window, cap)
        ids = {r.alert_id for r in emitted.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    want = loop(rows, window, cap)
    assert got == want
    assert ids == {i for i, d in want.items() if d == "emitted"}


def test_window_edge_and_cap_edge(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("a", "s", "f", at(0)), ("b", "s", "f", at(299)), ("c", "s", "f", at(300)), ("d", "s", "f", at(599))]
    assert labels(suppress.label_alerts(frame(spark, rows), 300, 10)) == {
        "a": "emitted", "b": "suppressed", "c": "emitted", "d": "suppressed",
    }
    rows = [(f"{i:02d}", "s", f"f{i}", at(i)) for i in range(11)] + [("next", "s", "f99", at(3600))]
    got = labels(suppress.label_alerts(frame(spark, rows), 300, 10))
    assert got["09"] == "emitted" and got["10"] == "limited" and got["next"] == "emitted"


@pytest.mark.parametrize("window,cap,counts", [
    (300, 10, (67, 0, 3964)), (3600, 10, (701, 0, 3330)), (3600, 2, (635, 329, 3067)),
])
def test_known_counts(spark, small, window, cap, counts):
    logs = tables.logs(spark, small).filter(F.col("level").isin("WARN", "ERROR", "FATAL"))
    alerts = logs.select(
        F.col("id").alias("alert_id"), "service_name", F.col("event_ts").alias("created_at"),
        F.concat_ws("|", "service_name", "hostname", "level").alias("fingerprint"),
    )
    got = labels(suppress.label_alerts(alerts, window, cap))
    tally = tuple(sum(v == d for v in got.values()) for d in ("suppressed", "limited", "emitted"))
    assert tally == counts


def test_rows_that_refuse_suppression(spark):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [("a", "s", "f", at(0), True), ("b", "s", "f", at(1), False), ("c", "s", "f", at(2), False), ("d", "s", "f", at(3), True)]
    df = spark.createDataFrame(
        rows, "alert_id string, service_name string, fingerprint string, created_at timestamp_ntz, suppress_duplicates boolean"
    )
    got = labels(suppress.label_alerts(df, 300, 2))
    assert got == {"a": "emitted", "b": "emitted", "c": "limited", "d": "suppressed"}
    assert labels(suppress.label_alerts(df, 300, None))["c"] == "emitted"


def jobs_of(spark, fn):
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "count")
    try:
        fn()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("cap", [None, 10_000])
def test_even_repeats_of_one_fingerprint_need_no_long_walk(spark, cap):
    """One alert per second: the chains of neighbouring ranges never meet, so a walk would take a pass per range."""
    n = 6_000
    rows = spark.range(n).select(
        F.concat(F.lit("a"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("alert_id"), F.lit("hot").alias("service_name"),
        F.lit("f").alias("fingerprint"), F.expr("timestamp_ntz'2024-01-01 00:00:07' + make_dt_interval(0, 0, 0, id)").alias("created_at"),
    )
    want = {f"a{k:06d}" for k in range(0, n, 300)}
    counts = {}
    for parts in (8, 32):
        got = []
        counts[parts] = jobs_of(
            spark, lambda: got.extend(r.alert_id for r in suppress.emit(rows, 300, cap, partitions=parts).collect())
        )
        assert set(got) == want and len(got) == len(want)
    assert counts[32] <= counts[8] + 2


@pytest.mark.parametrize("windows", [0.1, 1, 1.5, 2.5])
def test_even_spacing_gives_one_row_an_alert(spark, windows):
    rows = [(f"id{i:04d}", "s", f"f{i % 2}", START + dt.timedelta(seconds=300 * windows * (i // 2))) for i in range(400)]
    got = suppress.label_alerts(frame(spark, rows), 300, None).select("alert_id", "decision").collect()
    assert len(got) == len(rows) and {r.alert_id: r.decision for r in got} == loop(rows, 300, None)
    times = spark.createDataFrame([("f", int(300e6 * windows * i)) for i in range(200)], "fp string, t bigint")
    reached = suppress.emitted_chain(times, 300_000_000)
    assert reached.count() == reached.distinct().count() <= 200


def test_pauses_and_bursts_mixed(spark):
    rnd = random.Random(9)
    at, rows = 0.0, []
    for i in range(500):
        at += rnd.choice([1, 10, 299, 300, 301, 450, 599, 600, 2000])
        rows.append((f"id{i:04d}", "s", "f", START + dt.timedelta(seconds=at)))
    got = suppress.label_alerts(frame(spark, rows), 300, None).select("alert_id", "decision").collect()
    assert len(got) == 500 and {r.alert_id: r.decision for r in got} == loop(rows, 300, None)
