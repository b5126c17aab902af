"""Streaming jobs from raw records to alerts, incidents and dashboards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertflow.operators import alerts as al
from alertflow.operators import incidents, postings, scoring
from alertflow.sources import intake
from alertflow.sources.tables import write_routed

EVERY = {"processingTime": "30 seconds"}
ONCE = {"availableNow": True}


def logs_from_raw(raw: DataFrame, value: str = "value") -> DataFrame:
    """Good log rows of a raw stream; the arrival time stands in for a missing time.

    Records without an id and with equal content are one record here; ``start_intake`` keeps them apart.
    """
    good, _ = intake.split_malformed(intake.ingest_logs(raw, value))
    return intake.normalise_logs(good, F.current_timestamp().cast("timestamp_ntz"))


def alerts_from_logs(
    logs: DataFrame, score: Callable[[DataFrame], DataFrame] = scoring.score_default, min_score: float = 0.1
) -> DataFrame:
    return al.build_alerts(al.alert_candidates(score(logs), min_score))


def run_batches(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """foreachBatch with the batch kept while several sinks read it."""

    def step(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            each(kept, batch_id)
        finally:
            kept.unpersist()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    return writer.foreachBatch(step).trigger(**(trigger or ONCE)).start()


def start_intake(raw: DataFrame, logs_path: str, dead_path: str, checkpoint: str, trigger: dict | None = None):
    """Raw records to a log table and a dead-letter table. Each batch owns its folder, so a batch
    that is replayed after a failure overwrites itself. A batch is parsed once for both."""

    def each(batch: DataFrame, batch_id: int) -> None:
        good, bad = intake.split_malformed(batch)
        now = F.current_timestamp().cast("timestamp_ntz")
        intake.normalise_logs(good, now, F.lit(batch_id)).write.mode("overwrite").parquet(f"{logs_path}/batch={batch_id}")
        intake.dead_letters(bad, now).write.mode("overwrite").parquet(f"{dead_path}/batch={batch_id}")

    return run_batches(intake.ingest_logs(raw), each, checkpoint, trigger)


def start_scoring(logs: DataFrame, settings: str, path: str, checkpoint: str, trigger: dict | None = None):
    """Logs to scored rows. The settings table (name, value) below ``settings`` is read anew for every batch, so a changed
    ``anomaly_threshold`` holds from the next batch on without a restart; a batch that is repeated takes the newest value."""

    def each(batch: DataFrame, batch_id: int) -> None:
        config = batch.sparkSession.read.schema("name string, value double").parquet(settings)
        threshold = scoring.setting(config, "anomaly_threshold", scoring.MODEL_THRESHOLD)
        scoring.score_heuristic(batch, threshold).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_batches(logs, each, checkpoint, trigger)


def start_postings(versions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Incident rows to the search table. The last row of an incident in a batch, by ``updated_at``, counts."""

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = [c for c in batch.columns if c != "alert_id"]
        newest = batch.groupBy("alert_id").agg(F.max_by(F.struct(*kept), "updated_at").alias("_r")).select("alert_id", "_r.*")
        postings.write_postings(newest, path, batch_id)

    return run_batches(versions, each, checkpoint, trigger)


def start_routing(emitted: DataFrame, path: str, checkpoint: str, deliveries: str | None = None, trigger: dict | None = None):
    """Emitted alerts to topic folders, and one row per queue to the delivery table."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_routed(batch, path, batch_id)
        if deliveries:
            al.fan_out(batch).write.mode("overwrite").parquet(f"{deliveries}/batch={batch_id}")

    return run_batches(emitted, each, checkpoint, trigger)


def current_incidents(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest row of every incident that ``start_incidents`` wrote; ``before`` leaves out that batch and later ones."""
    rows = spark.read.parquet(path)
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    kept = [c for c in rows.columns if c != "batch"]
    return rows.groupBy("alert_id").agg(F.max_by(F.struct(*kept), "batch").alias("_r")).select("_r.*")


def start_incidents(versions: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Fold alert versions into incidents batch by batch.

    A batch writes the incidents it touches, as they are after it, to a folder of its own, and reads only folders of
    earlier batches, so a repeated batch replaces itself. Where a table format with MERGE INTO is at hand, merge instead.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id:
            known = current_incidents(batch.sparkSession, path, batch_id)
            touched = known.join(batch.select("alert_id").distinct(), "alert_id", "left_semi")
            out = incidents.apply_versions(touched, batch)
        else:
            out = incidents.fold_incidents(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_batches(versions, each, checkpoint, trigger)


def running_counters(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("service_name", "severity", "status").agg(
        F.count("*").alias("alerts"), F.max("created_at").alias("last_seen")
    )


def start_counters(alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Running alert counts by service, severity and status, refreshed at every trigger."""
    counts = running_counters(alerts)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/refresh={batch_id}")

    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(each).trigger(**(trigger or EVERY)).start()


def minute_series(alerts: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Alerts per minute as a stream; a minute is final once the watermark has passed it."""
    clock = alerts.withColumn("_clock", F.col("created_at").cast("timestamp")).withWatermark("_clock", lateness)
    counted = clock.groupBy(F.window("_clock", "1 minute")).agg(F.count("*").alias("alerts"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("minute"), "alerts")
