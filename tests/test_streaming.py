"""Streams over file sources give the batch result, also after a restart."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from alertflow.operators import alerts as al
from alertflow.operators import dashboards, incidents, scoring, suppress
from alertflow.plans import lifecycle, tables
from alertflow.schemas import ALERT
from alertflow.sources import intake
from alertflow.sources import tables as src
from alertflow.streaming import flow, suppression, waiting

FAR = dt.datetime(2025, 1, 1)


def in_files(df, path, n, ts):
    """Write ``df`` as ``n`` files that follow each other in time."""
    placed = df.withColumn("_part", F.ntile(n).over(Window.orderBy(ts))).persist()
    for i in range(1, n + 1):
        placed.filter(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    placed.unpersist()


@pytest.fixture(scope="module")
def alert_rows(spark, tiny):
    rows = al.build_alerts(al.alert_candidates(scoring.score_default(tables.logs(spark, tiny))))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in ALERT.fields])


def flush_row(spark, alert_rows, service):
    """A far later alert per key, to let the watermark pass everything before it."""
    return alert_rows.limit(1).withColumns(
        {
            "alert_id": F.lit(f"flush-{service}"),
            "service_name": F.lit(service),
            "fingerprint": F.lit(f"flush-{service}"),
            "created_at": F.lit(FAR),
        }
    ).select(*alert_rows.columns)


@pytest.mark.parametrize("window,cap", [(3600, 2), (300, None)])
def test_stream_decides_like_batch(spark, alert_rows, tmp_path, window, cap):
    path, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    in_files(alert_rows, path, 3, "created_at")

    def run():
        stream = src.read_folder(spark, path, ALERT, streaming=True, files_per_trigger=1)
        decided = suppression.decide_stream(stream, window, cap, lateness="0 seconds")
        q = (
            decided.select("alert_id", "decision").writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", chk).outputMode("append").trigger(availableNow=True).start()
        )
        assert q.awaitTermination(240) and q.exception() is None

    run()
    # restart from the checkpoint with one more file, far in the future
    flush_row(spark, alert_rows, "none").coalesce(1).write.mode("append").parquet(path)
    run()
    got = {r.alert_id: r.decision for r in spark.read.parquet(out).collect() if not r.alert_id.startswith("flush")}
    want = {r.alert_id: r.decision for r in suppress.label_alerts(alert_rows, window, cap).collect()}
    assert got == want
    assert suppression.late_alerts(alert_rows, spark.read.parquet(out)).count() == 0


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, ROCKS)
    yield spark
    spark.conf.unset(name)


@pytest.mark.parametrize("window,cap", [(3600, 2), (300, None)])
def test_rows_in_chunks_are_decided_like_batch(rocks, alert_rows, tmp_path, window, cap):
    path, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    in_files(alert_rows, path, 3, "created_at")
    # late: comes when the watermark is weeks past it
    late = alert_rows.orderBy("created_at").limit(1).withColumns({"alert_id": F.lit("late"), "created_at": F.col("created_at") - F.expr("INTERVAL '1' SECOND")})
    late = rocks.createDataFrame(late.collect(), late.schema)

    def run():
        stream = src.read_folder(rocks, path, ALERT, streaming=True, files_per_trigger=1)
        decided = waiting.decide_rows(stream, window, cap, lateness="0 seconds")
        q = (
            decided.select("alert_id", "decision").writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", chk).outputMode("append").trigger(availableNow=True).start()
        )
        assert q.awaitTermination(240) and q.exception() is None

    run()
    flush_row(rocks, alert_rows, "none").coalesce(1).write.mode("append").parquet(path)
    run()
    late.coalesce(1).write.mode("append").parquet(path)
    run()
    rows = [(r.alert_id, r.decision) for r in rocks.read.parquet(out).collect() if not r.alert_id.startswith("flush")]
    want = {r.alert_id: r.decision for r in suppress.label_alerts(alert_rows, window, cap).collect()}
    assert len(rows) == len(want) and dict(rows) == want

    # stream and corrections together are the answer of one batch over everything
    everything = alert_rows.unionByName(late)
    given = rocks.read.parquet(out).filter(~F.col("alert_id").startswith("flush"))
    fixed = dict(rows) | {r.alert_id: r.decision for r in suppress.corrections(everything, given, window, cap).collect()}
    assert fixed == {r.alert_id: r.decision for r in suppress.label_alerts(everything, window, cap).collect()}


class _Map(dict):
    """State of one key, with a count of what is written."""

    def __init__(self):
        super().__init__()
        self.writes = 0

    def getValue(self, k):
        return self[k]

    def containsKey(self, k):
        return k in self

    def updateValue(self, k, v):
        self.writes += sum(len(x) for x in v if isinstance(x, list))
        self[k] = v

    def removeKey(self, k):
        del self[k]


class _Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v

    def clear(self):
        self.value = None


def test_a_ripe_row_rewrites_its_chunk_only():
    import pandas as pd

    class Handle:
        timers: list = []

        def getMapState(self, *a):
            return _Map()

        def getValueState(self, *a):
            return _Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    s = waiting.Suppressor(300 * suppress.MICROS, None, 3600 * suppress.MICROS)
    s.init(Handle())
    n = 100_000
    rows = pd.DataFrame({"t": [i * suppress.MICROS for i in range(n)], "fp": "f", "id": [f"{i:06d}" for i in range(n)]})
    list(s.handleInputRows(("f",), iter([rows]), At(0)))
    assert s.waiting.writes == 3 * n
    (got,) = s.handleExpiredTimer(("f",), At(10_000), None)
    assert len(got) == 11 and s.waiting.writes - 3 * n <= 3 * waiting.CHUNK
    (got,) = s.handleExpiredTimer(("f",), At((n + 10_000) * 1000), None)
    assert len(got) == n - 11 and (got["decision"] == suppress.EMITTED).sum() == (n - 1) // 300
    assert not s.waiting and not s.last and not s.ends and not s.hour.exists()


def test_raw_records_to_logs_and_dead_letters(spark, tmp_path):
    good = '{"id":"a","serviceName":"s","level":"ERROR","message":"m","timestamp":"2024-01-01T00:00:00"}'
    rows = [
        good,
        '{"id":"b","serviceName":"s","level":"CRITICAL","message":"m"}',
        '{"id":"c","serviceName":"s","level":"WA',
        '{"serviceName":"s","level":"WARN","message":"no id"}',
    ]
    raw = str(tmp_path / "raw")
    spark.createDataFrame([(r,) for r in rows], "value string").write.parquet(raw)
    stream = spark.readStream.schema("value string").parquet(raw)
    q = flow.start_intake(stream, str(tmp_path / "logs"), str(tmp_path / "dead"), str(tmp_path / "chk"))
    assert q.awaitTermination(120) and q.exception() is None
    logs = spark.read.parquet(str(tmp_path / "logs"))
    assert {r.message for r in logs.collect()} == {"m", "no id"}
    assert logs.filter("id is null or event_ts is null").count() == 0
    reasons = {r.reject_reason for r in spark.read.parquet(str(tmp_path / "dead")).collect()}
    assert reasons == {"unknown level CRITICAL", "not a valid record"}


def test_routed_write_replaces_a_repeated_batch(spark, alert_rows, tmp_path):
    path = str(tmp_path / "alerts")
    for _ in range(2):
        src.write_routed(alert_rows, path, batch_id=4)
    back = spark.read.parquet(path)
    assert back.count() == alert_rows.count()
    critical = src.read_alerts(spark, path, ["alerts.critical"])
    assert critical.count() == alert_rows.filter(F.col("severity").isin("CRITICAL", "HIGH")).count()


def test_counters_and_minutes(spark, alert_rows, tmp_path):
    path = str(tmp_path / "in")
    alert_rows.coalesce(2).write.parquet(path)
    stream = src.read_folder(spark, path, ALERT, streaming=True)
    q = flow.start_counters(stream, str(tmp_path / "counts"), str(tmp_path / "chk"), flow.ONCE)
    assert q.awaitTermination(120) and q.exception() is None
    last = spark.read.parquet(str(tmp_path / "counts")).filter("refresh = 0")
    assert last.agg(F.sum("alerts")).first()[0] == alert_rows.count()

    flush_row(spark, alert_rows, "none").coalesce(1).write.mode("append").parquet(path)
    minutes = flow.minute_series(src.read_folder(spark, path, ALERT, streaming=True))
    q = (
        minutes.writeStream.format("parquet").option("path", str(tmp_path / "min"))
        .option("checkpointLocation", str(tmp_path / "chk2")).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(120) and q.exception() is None
    got = {(r.minute, r.alerts) for r in spark.read.parquet(str(tmp_path / "min")).collect()}
    want = {
        (r.minute, r.alerts)
        for r in dashboards.time_series(alert_rows, F.lit(FAR), 24 * 400).collect()
    }
    assert got == want


def test_dedupe_on_a_stream(spark, tiny, tmp_path):
    rows = tables.logs(spark, tiny).select("id", "event_ts")
    path = str(tmp_path / "in")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    q = (
        intake.dedupe(stream, lateness="60 days").writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "chk")).trigger(availableNow=True).start()
    )
    assert q.awaitTermination(120) and q.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_scored_stream_to_routing_and_deliveries(spark, tiny, tmp_path):
    at = lambda n: str(tmp_path / n)
    logs = tables.logs(spark, tiny)
    raw = logs.select(F.to_json(F.struct("id", F.col("service_name").alias("serviceName"), "hostname", "level", "message",
                                         F.col("event_ts").alias("timestamp"))).alias("value"))
    raw.coalesce(2).write.parquet(at("raw"))
    good = flow.logs_from_raw(spark.readStream.schema("value string").parquet(at("raw")))
    scored = scoring.score_default(good)
    q = src.write_scored(scored, at("scored"), at("chk1"))
    assert q.awaitTermination(120) and q.exception() is None
    back = src.read_scored(spark, at("scored"))
    assert back.count() == logs.count()

    found = al.build_alerts(al.alert_candidates(src.read_scored(spark, at("scored"), streaming=True)))
    q = flow.start_routing(found, at("alerts"), at("chk2"), deliveries=at("deliveries"))
    assert q.awaitTermination(120) and q.exception() is None
    want = al.fan_out(al.build_alerts(al.alert_candidates(scoring.score_default(logs))))
    key = lambda df: {(r.alert_id, r.queue) for r in df.select("alert_id", "queue").collect()}
    assert key(spark.read.parquet(at("deliveries"))) == key(want)
    assert src.read_alerts(spark, at("alerts")).count() == want.filter("queue = 'notifications'").count()


def test_incident_stream_equals_one_fold(spark, tiny, tmp_path):
    v = lifecycle.versions(spark, tiny)
    path, table = str(tmp_path / "versions"), str(tmp_path / "incidents")
    in_files(v, path, 3, "version_ts")
    cols = ["alert_id", "status", "severity", "assignee", "resolved_at", "time_to_resolve", "time_to_acknowledge",
            "escalation_count", "reopen_count", "impact_score", "updated_at", "expires_at"]
    want = {tuple(r) for r in incidents.fold_incidents(v).select(cols).collect()}
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(path)
    for chk in ("a", "b"):  # the second run repeats every batch over the folders of the first
        q = flow.start_incidents(stream, table, str(tmp_path / chk))
        assert q.awaitTermination(240) and q.exception() is None
        got = [tuple(r) for r in flow.current_incidents(spark, table).select(cols).collect()]
        assert len(got) == len(want) and set(got) == want


def test_ids_do_not_depend_on_the_clock(spark):
    rows = spark.createDataFrame([(None, "s", "h", "WARN", "no time", None)] * 2, "id string, service_name string, hostname string, level string, message string, event_ts timestamp_ntz")
    ids = [{r.id for r in intake.normalise_logs(rows, F.lit(at)).collect()} for at in (FAR, dt.datetime(2024, 5, 5))]
    assert ids[0] == ids[1] and len(ids[0]) == 2
