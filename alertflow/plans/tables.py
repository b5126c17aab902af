"""Named inputs for the registered queries: the derived ``logs`` table and tables built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertflow.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str, wide: bool = False) -> DataFrame:
    """A given table; ``wide`` asks for at least one task per core, for costly row work."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if wide else rows


def logs(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Log rows derived from ``events``; one narrow projection, no shuffle."""
    e = table(spark, sf_dir, "events", wide).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind, user = F.col("k"), F.col("event_type"), F.col("user_id")
    ks = k.cast("string")
    err = kind == "error"
    return e.select(
        F.concat(F.lit("log-"), F.col("event_id").cast("string")).alias("id"),
        F.col("ts").alias("event_ts"),
        F.when(user % 4 == 0, "auth-service")
        .when(user % 4 == 1, "payment-service")
        .when(user % 4 == 2, "order-service")
        .otherwise("gateway-service")
        .alias("service_name"),
        F.concat(F.lit("pod-"), (user % 3).cast("string")).alias("hostname"),
        F.lit(None).cast("string").alias("pod_name"),
        F.when(err & (k >= 90), "FATAL")
        .when(err, "ERROR")
        .when(kind == "signup", "WARN")
        .when(kind == "view", "DEBUG")
        .otherwise("INFO")
        .alias("level"),
        F.when(err & (k % 3 == 0), F.concat(F.lit("Connection timeout after 30 seconds to 10.0.0."), ks))
        .when(err & (k % 3 == 1), F.concat(F.lit("NullPointerException in handler "), ks))
        .when(err, F.concat(F.lit("Authentication failed for user"), user.cast("string"), F.lit("@example.com")))
        .when(kind == "signup", F.concat(F.lit("Slow login flow, retry token "), ks))
        .when(kind == "view", F.concat(F.lit("Cache hit for key "), ks))
        .otherwise(F.concat(F.lit("Request processed successfully https://example.com/p/"), ks))
        .alias("message"),
        F.when(err & (k % 2 == 0), "java.sql.SQLException").alias("exception"),
        F.when(err & (k % 4 == 0), F.concat(F.lit("at com.example.Dao.run(Dao.java:"), ks, F.lit(")"))).alias(
            "stack_trace"
        ),
        F.when(k % 10 <= 5, 200).when(k % 10 == 6, 302).when(k % 10 == 7, 404).when(k % 10 == 8, 500).alias(
            "http_status"
        ),
        (F.col("value") * F.lit(20.0)).alias("duration_ms"),
        (k * 5).alias("line_number"),
        F.when(k < 50, F.concat(F.lit("trace-"), F.floor(F.col("event_id") / 5).cast("string"))).alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.lit(None).cast("string").alias("logger"),
        F.create_map(F.lit("k"), ks, F.lit("traceId"), F.lit("from-metadata")).alias("metadata"),
    )


LOGS = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
logs AS (SELECT 'log-' || event_id AS id, ts AS event_ts, event_id, k,
  CASE user_id % 4 WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service' WHEN 2 THEN 'order-service'
    ELSE 'gateway-service' END AS service_name,
  'pod-' || (user_id % 3) AS hostname, CAST(NULL AS VARCHAR) AS pod_name,
  CASE WHEN event_type = 'error' AND k >= 90 THEN 'FATAL' WHEN event_type = 'error' THEN 'ERROR'
    WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
  CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'Connection timeout after 30 seconds to 10.0.0.' || k
    WHEN event_type = 'error' AND k % 3 = 1 THEN 'NullPointerException in handler ' || k
    WHEN event_type = 'error' THEN 'Authentication failed for user' || user_id || '@example.com'
    WHEN event_type = 'signup' THEN 'Slow login flow, retry token ' || k
    WHEN event_type = 'view' THEN 'Cache hit for key ' || k
    ELSE 'Request processed successfully https://example.com/p/' || k END AS message,
  CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 'java.sql.SQLException' END AS exception,
  CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'at com.example.Dao.run(Dao.java:' || k || ')' END AS stack_trace,
  CASE WHEN k % 10 <= 5 THEN 200 WHEN k % 10 = 6 THEN 302 WHEN k % 10 = 7 THEN 404 WHEN k % 10 = 8 THEN 500 END
    AS http_status,
  value * 20 AS duration_ms, k * 5 AS line_number,
  CASE WHEN k < 50 THEN 'trace-' || CAST(floor(event_id / 5) AS BIGINT) END AS trace_id
  FROM e)"""


def sql(*parts: str) -> str:
    """Named sub-queries followed by the final SELECT."""
    *ctes, body = parts
    return f"WITH RECURSIVE {', '.join(ctes)}\n{body}" if ctes else body
