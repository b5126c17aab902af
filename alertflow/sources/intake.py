"""Raw records to typed log rows: parsing, defaults, headers, malformed input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertflow.functions import rules
from alertflow.schemas import LEVELS, LOG_EVENT, RAW_LOG
from alertflow.session import once

CORRUPT = "_corrupt_record"
# Wire name of each canonical column where the two differ.
WIRE_NAMES = {
    "event_ts": "timestamp", "service_name": "serviceName", "pod_name": "podName", "stack_trace": "stackTrace",
    "trace_id": "traceId", "span_id": "spanId",
}


def ingest_logs(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to canonical columns, plus the text itself and why it is bad, if it is.

    The schema is fixed, so nothing is inferred and the same plan serves a batch,
    a list of records or a stream.
    """
    schema = T.StructType([*RAW_LOG.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    text = F.col(value).cast("string")
    parsed = once(raw.select(text.alias("payload")), "_j", F.from_json("payload", schema, options))
    named = parsed.select(
        "payload",
        *[F.col(f"_j.{WIRE_NAMES.get(f.name, f.name)}").cast(f.dataType).alias(f.name) for f in LOG_EVENT.fields],
        F.col(f"_j.{CORRUPT}").alias("_corrupt"),
    )
    reason = (
        F.when(F.col("payload").isNull() | F.col("_corrupt").isNotNull(), F.lit("not a valid record"))
        .when(F.col("level").isNull(), F.lit("missing level"))
        .when(~F.col("level").isin(*LEVELS), F.concat(F.lit("unknown level "), F.col("level")))
    )
    return named.withColumn("reject_reason", reason).drop("_corrupt")


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good log rows, rejected payloads). Both are filters over the same scan."""
    good = parsed.filter(F.col("reject_reason").isNull()).drop("payload", "reject_reason")
    return good, parsed.filter(F.col("reject_reason").isNotNull())


def dead_letters(bad: DataFrame, as_of: Column) -> DataFrame:
    return bad.select("payload", "reject_reason", as_of.alias("rejected_at"))


def normalise_logs(logs: DataFrame, as_of: Column, position: Column | None = None) -> DataFrame:
    """Fill a missing time with ``as_of`` and a missing id with a hash that no two records share.

    ``position`` is where a record comes from (topic, partition and offset; file and row; batch): it tells equal records
    apart and makes a replay give the same ids. In a batch, equal records are also numbered, so ``position`` may be left
    out or be the same for all. On a stream a record is known by ``position`` and content only. A missing time counts as
    missing in the hash: the id does not depend on the clock that stands in for it.
    """
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', event_ts)").cast("string")
    none = F.lit("\\N")
    told = [F.coalesce(c, none) for c in ("service_name", "hostname", "level", "message")] + [F.coalesce(micros, none)]
    told += [] if position is None else [position.cast("string")]
    filled = F.coalesce("event_ts", as_of)
    if logs.isStreaming:
        return logs.withColumn("id", F.coalesce("id", _log_id(told))).withColumn("event_ts", filled)
    out = logs.withColumn("_content", F.concat_ws("|", *told)).withColumn("event_ts", filled)
    lacking, out = out.filter(F.col("id").isNull()), out.drop("_content")
    same = Window.partitionBy("_content").orderBy(F.to_json(F.struct(*logs.columns)))
    lacking = lacking.withColumn("_nth", F.row_number().over(same))
    named = lacking.withColumn("id", _log_id([F.col("_content"), F.col("_nth").cast("string")]))
    return out.filter(F.col("id").isNotNull()).unionByName(named.drop("_content", "_nth"))


def _log_id(parts: list[Column]) -> Column:
    return F.concat(F.lit("LOG-"), rules.short_hash(F.concat_ws("|", *parts)))


def with_headers(logs: DataFrame) -> DataFrame:
    """``headers`` in the shape the Kafka sink takes."""

    def header(key: str, value: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), F.encode(value, "UTF-8").alias("value"))

    return logs.withColumn(
        "headers", F.array(header("service", F.col("service_name")), header("level", F.col("level")))
    )


def delivery_headers(deliveries: DataFrame) -> DataFrame:
    """(header name, value) pairs of a queue message as a map."""
    flags = F.map_filter(
        F.create_map(
            F.lit("actionRequired"), F.when(F.col("action_required"), F.lit("true")),
            F.lit("urgent"), F.when(F.col("urgent"), F.lit("true")),
        ),
        lambda k, v: v.isNotNull(),
    )
    fixed = F.create_map(
        F.lit("alertId"), F.col("alert_id"), F.lit("severity"), F.col("severity"),
        F.lit("serviceName"), F.col("service_name"),
    )
    return deliveries.withColumn("headers", F.map_concat(fixed, flags))


def partition_by_service(logs: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of a service in time order, a service spread over neighbouring partitions.

    Ranges on (service, time, id) keep the order inside a service while a service
    with a third of all rows still fills a third of the partitions, not one.
    """
    cols = ["service_name", "event_ts", "id"]
    ranged = logs.repartitionByRange(n, *cols) if n else logs.repartitionByRange(*cols)
    return ranged.sortWithinPartitions(*cols)


def dedupe(rows: DataFrame, id_col: str = "id", ts: str = "event_ts", lateness: str | None = None) -> DataFrame:
    """One row per id: the earliest delivery, equal times in order of their text.

    On a stream the first to arrive is kept, with state for ``lateness`` behind the watermark.
    """
    if not rows.isStreaming:
        row = F.struct(*rows.columns)
        return rows.groupBy(id_col).agg(F.min_by(row, F.struct(ts, F.to_json(row))).alias("_first")).select("_first.*")
    if lateness is None:
        raise ValueError("a stream needs a lateness bound")
    clock = rows.withColumn("_wm", F.col(ts).cast("timestamp"))
    return clock.withWatermark("_wm", lateness).dropDuplicatesWithinWatermark([id_col]).drop("_wm")
