"""Readers and writers for topics and tables, in batch and as streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertflow.operators.alerts import TOPIC_CRITICAL, TOPIC_INFO, route_topic
from alertflow.schemas import ALERT, SCORED_LOG


def kafka_options(servers: str, topics: Sequence[str], starting: str = "earliest", per_trigger: int | None = None) -> dict:
    out = {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(topics),
        "startingOffsets": starting,
        "failOnDataLoss": "true",
    }
    if per_trigger:
        out["maxOffsetsPerTrigger"] = str(per_trigger)
    return out


def read_kafka(spark: SparkSession, servers: str, topics: Sequence[str], streaming: bool = True, **kw) -> DataFrame:
    """Key, value, topic and headers of the given topics. Needs the Kafka package on the class path."""
    reader = spark.readStream if streaming else spark.read
    options = kafka_options(servers, topics, **kw)
    return reader.format("kafka").options(**options, includeHeaders="true").load()


def read_folder(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    fmt: str = "parquet",
    streaming: bool = False,
    files_per_trigger: int | None = None,
    newest_first: bool = False,
) -> DataFrame:
    """A folder of files as a table or a stream; the schema is always given."""
    if not streaming:
        paths = [path] if isinstance(path, str) else list(path)
        return spark.read.format(fmt).schema(schema).load(paths)
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if newest_first:
        reader = reader.option("latestFirst", "true")
    return reader.load(path)


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a plain scan over at least as many tasks as there are cores.

    Costly per-row work on one small file would otherwise run in one task. A scan
    that already has enough partitions, as any large table does, is left alone.
    """
    if scan.isStreaming:
        return scan
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def read_scored(spark: SparkSession, path: str, streaming: bool = False, **kw) -> DataFrame:
    """Scored logs from the beginning; with a checkpoint a restart goes on where it stopped."""
    return read_folder(spark, path, SCORED_LOG, streaming=streaming, **kw)


def read_alerts(
    spark: SparkSession,
    path: str,
    topics: Sequence[str] = (TOPIC_CRITICAL, TOPIC_INFO),
    start: str = "earliest",
    as_of=None,
    streaming: bool = False,
    **kw,
) -> DataFrame:
    """Several alert topics as one table. Topics are folders, so others are never listed or read;
    ``start='latest'`` keeps only alerts created from ``as_of`` on."""
    schema = T.StructType([*ALERT.fields, T.StructField("topic", T.StringType())])
    rows = read_folder(spark, path, schema, streaming=streaming, **kw).filter(F.col("topic").isin(*topics))
    return rows if start == "earliest" else tail(rows, as_of)


def tail(rows: DataFrame, as_of, ts: str = "created_at") -> DataFrame:
    return rows.filter(F.col(ts) >= (F.lit(as_of) if not hasattr(as_of, "cast") else as_of))


def union_topics(*tables: DataFrame) -> DataFrame:
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t)
    return first


def kafka_rows(rows: DataFrame, key: str = "service_name") -> DataFrame:
    """Key and JSON value columns for a Kafka sink."""
    kept = [c for c in rows.columns if c not in ("headers", "topic")]
    extra = [c for c in ("headers", "topic") if c in rows.columns]
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*kept)).alias("value"), *extra)


def write_scored(scored: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Append scored logs by day; a stream when ``scored`` is one."""
    rows = scored.withColumn("event_date", F.to_date("event_ts"))
    if not scored.isStreaming:
        rows.write.mode("append").partitionBy("event_date").parquet(path)
        return None
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy("event_date").trigger(**(trigger or {"availableNow": True})).start()


def routed_rows(alerts: DataFrame, batch_id: int | None = None) -> tuple[DataFrame, list[str]]:
    """Alerts with the columns that name their folder."""
    rows = route_topic(alerts) if "topic" not in alerts.columns else alerts
    if batch_id is None:
        return rows, ["topic"]
    return rows.withColumn("batch", F.lit(int(batch_id))), ["batch", "topic"]


def write_routed(alerts: DataFrame, path: str, batch_id: int | None = None) -> None:
    """One pass writes every topic to its folder. With a batch id the files go to a folder of that
    batch, so a repeated batch replaces itself."""
    out, by = routed_rows(alerts, batch_id)
    if batch_id is None:
        out.write.mode("append").partitionBy(*by).parquet(path)
        return
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
