"""Scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.operators import scoring
from alertflow.plans.registry import Plans
from alertflow.plans.tables import LOGS, logs, sql

plans = Plans()
joined = lambda c: F.array_join(c, "; ")

DEFAULT = """scored_default AS (SELECT *,
  CASE WHEN level IN ('ERROR', 'FATAL') THEN 0.7::DOUBLE WHEN level = 'WARN' THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END
    AS anomaly_score FROM logs)"""

HEURISTIC = """scored_heuristic AS (SELECT *, list_filter([
    CASE level WHEN 'ERROR' THEN 'Error level log' WHEN 'FATAL' THEN 'Fatal level log' WHEN 'WARN' THEN 'Warning level log' END,
    CASE WHEN exception <> '' THEN 'Exception present' END,
    CASE WHEN http_status >= 500 THEN 'Server error: ' || http_status END,
    CASE WHEN duration_ms > 5000 THEN 'High response time' END], lambda x: x IS NOT NULL) AS all_reasons,
  CASE WHEN level IN ('ERROR', 'FATAL') THEN 'error_spike' WHEN duration_ms > 5000 THEN 'performance_degradation'
    ELSE 'unknown' END AS kind,
  least(CASE level WHEN 'ERROR' THEN 0.7::DOUBLE WHEN 'FATAL' THEN 0.9::DOUBLE WHEN 'WARN' THEN 0.4::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN exception <> '' THEN 0.3::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN http_status >= 500 THEN 0.4::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN duration_ms > 5000 THEN 0.3::DOUBLE ELSE 0::DOUBLE END, 1::DOUBLE) AS anomaly_score
  FROM logs),
heuristic AS (SELECT *, anomaly_score > 0.7::DOUBLE AS is_anomaly,
  CASE WHEN anomaly_score > 0.7::DOUBLE THEN kind END AS anomaly_type,
  CASE WHEN anomaly_score > 0.7::DOUBLE THEN all_reasons ELSE [] END AS anomaly_reasons FROM scored_heuristic)"""

SECURITY = """(regexp_matches(lower(message), 'auth|login|password|token|security|attack|injection') AND level IN ('ERROR', 'WARN'))"""
TYPES = f"""typed AS (SELECT *, CASE WHEN {SECURITY} THEN 'security_threat'
  WHEN http_status >= 500 THEN 'error_spike' WHEN http_status >= 400 THEN 'security_threat'
  WHEN duration_ms > 5000 THEN 'performance_degradation'
  WHEN level IN ('ERROR', 'FATAL') THEN CASE WHEN contains(lower(message), 'exception') OR coalesce(exception, '') <> ''
    THEN 'error_spike' ELSE 'unusual_pattern' END
  ELSE 'unknown' END AS anomaly_type FROM logs)"""

ADVICE = """CASE WHEN {s} > 0.9::DOUBLE THEN 'HIGH PRIORITY: Immediate investigation required; ' ELSE '' END || CASE {t}
  WHEN 'error_spike' THEN 'Investigate ' || service_name || ' service health; Check recent deployments or configuration changes; Monitor error rates and patterns'
  WHEN 'performance_degradation' THEN 'Check resource utilization (CPU, memory, disk); Analyze database query performance; Review network connectivity'
  WHEN 'security_threat' THEN 'Review authentication logs; Check for potential security breaches; Verify user permissions and access patterns'
  ELSE 'Monitor service for similar patterns; Check service dependencies; Review application logs for context' END"""


def default(spark, d):
    return scoring.score_default(logs(spark, d))


def heuristic(spark, d, wide=False):
    return scoring.score_heuristic(logs(spark, d, wide))


@plans.add("ml_field_mapping", sql(LOGS, """SELECT id AS log_id, event_ts AS timestamp, service_name, hostname,
  upper(level) AS log_level, message, http_status, duration_ms FROM logs"""))
def _(spark, d):
    return scoring.to_ml_schema(logs(spark, d)).select(
        "log_id", "timestamp", "service_name", "hostname", "log_level", "message", "http_status", "duration_ms"
    )


@plans.add("score_default", sql(LOGS, DEFAULT, """SELECT id, anomaly_score, anomaly_score > 0.8::DOUBLE AS is_anomaly,
  'default' AS anomaly_type, 'AI service unavailable, default scoring applied' AS anomaly_reasons FROM scored_default"""))
def _(spark, d):
    return default(spark, d).select(
        "id", "anomaly_score", "is_anomaly", "anomaly_type", joined("anomaly_reasons").alias("anomaly_reasons")
    )


def answers(spark, d):
    """Model answers for two thirds of the logs; every fifth of them has no score."""
    n = F.substring("id", 5, 20).cast("bigint")
    h = heuristic(spark, d).filter(n % 3 != 0)
    given = h.select(
        "id",
        F.when(n % 5 != 0, F.col("anomaly_score")).alias("anomaly_score"),
        F.when(n % 5 != 0, F.col("anomaly_reasons")).alias("anomaly_reasons"),
        F.lit(None).cast("map<string,double>").alias("feature_scores"),
        "anomaly_type",
    )
    # a log is answered twice; the answer without a score loses
    empty = given.withColumns({"anomaly_score": F.lit(None).cast("double"), "anomaly_reasons": F.lit(None).cast("array<string>")})
    return given.unionByName(empty.filter(n % 5 != 0))


ANSWERS = """answers AS (SELECT id, CASE WHEN event_id % 5 <> 0 THEN anomaly_score END AS s,
  CASE WHEN event_id % 5 <> 0 THEN anomaly_reasons END AS r, anomaly_type AS t FROM heuristic WHERE event_id % 3 <> 0)"""


@plans.add("attach_scores", sql(LOGS, HEURISTIC, ANSWERS, """SELECT l.id, coalesce(s, 0::DOUBLE) AS anomaly_score,
  array_to_string(coalesce(r, []), '; ') AS anomaly_reasons, coalesce(t, 'unknown') AS anomaly_type,
  coalesce(s, 0::DOUBLE) > 0.8::DOUBLE AS is_anomaly, 0::INTEGER AS features
  FROM logs l LEFT JOIN answers a ON l.id = a.id"""))
def _(spark, d):
    out = scoring.attach_scores(logs(spark, d), answers(spark, d))
    return out.select(
        "id", "anomaly_score", joined("anomaly_reasons").alias("anomaly_reasons"), "anomaly_type", "is_anomaly",
        F.size("feature_scores").alias("features"),
    )


@plans.add("score_with_fallback", sql(LOGS, HEURISTIC, DEFAULT, ANSWERS, """SELECT l.id,
  CASE WHEN a.id IS NULL THEN l.anomaly_score ELSE coalesce(s, 0::DOUBLE) END AS anomaly_score,
  CASE WHEN a.id IS NULL THEN 'AI service unavailable, default scoring applied'
    ELSE array_to_string(coalesce(r, []), '; ') END AS anomaly_reasons,
  CASE WHEN a.id IS NULL THEN 'default' ELSE coalesce(t, 'unknown') END AS anomaly_type
  FROM scored_default l LEFT JOIN answers a ON l.id = a.id"""))
def _(spark, d):
    out = scoring.score_with_fallback(logs(spark, d), answers(spark, d))
    return out.select("id", "anomaly_score", joined("anomaly_reasons").alias("anomaly_reasons"), "anomaly_type")


@plans.add("score_heuristic", sql(LOGS, HEURISTIC, f"""SELECT id, anomaly_score, is_anomaly, anomaly_type,
  array_to_string(anomaly_reasons, '; ') AS anomaly_reasons, 0.6::DOUBLE AS confidence,
  '1.0.0_fallback' AS model_version, {ADVICE.format(s='anomaly_score', t='kind')} AS recommendations FROM heuristic"""))
def _(spark, d):
    return heuristic(spark, d).select(
        "id", "anomaly_score", "is_anomaly", "anomaly_type", joined("anomaly_reasons").alias("anomaly_reasons"),
        "confidence", "model_version", joined("recommendations").alias("recommendations"),
    )


def three(spark, d):
    """Raw scores of three made-to-measure models, derived from each row."""
    return logs(spark, d).select(
        "id",
        (-F.col("duration_ms") / F.lit(2000.0)).alias("isolation_forest"),
        F.when(F.col("http_status").isNotNull(), F.lit(0.5) - F.col("http_status") / F.lit(600.0)).alias("one_class_svm"),
        F.when(F.col("trace_id").isNotNull(), F.lit(0.0) - F.col("line_number") / F.lit(400.0)).alias(
            "local_outlier_factor"
        ),
    )


THREE = """raw AS (SELECT id, -duration_ms / 2000::DOUBLE AS a,
  CASE WHEN http_status IS NOT NULL THEN 0.5::DOUBLE - http_status / 600::DOUBLE END AS b,
  CASE WHEN trace_id IS NOT NULL THEN 0::DOUBLE - line_number / 400::DOUBLE END AS c FROM logs),
three AS (SELECT id, greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE - a)) AS a,
  CASE WHEN b IS NOT NULL THEN greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE - b)) END AS b,
  CASE WHEN c IS NOT NULL THEN greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE - c)) END AS c FROM raw)"""


def normalised(spark, d):
    raw = three(spark, d)
    return raw.select(
        "id", *[F.when(F.col(m).isNotNull(), scoring.normalise(F.col(m))).alias(m) for m in scoring.MODELS]
    )


@plans.add("normalise_scores", sql(LOGS, THREE, """SELECT id, round(a, 9) AS isolation_forest, round(b, 9) AS one_class_svm,
  round(c, 9) AS local_outlier_factor FROM three"""))
def _(spark, d):
    return normalised(spark, d).select("id", *[F.round(m, 9).alias(m) for m in scoring.MODELS])


def verdict(df):
    return df.select(
        "id", F.round("anomaly_score", 9).alias("anomaly_score"), "is_anomaly", F.round("confidence", 9).alias("confidence")
    )


MEAN = """SELECT id, round(s, 9) AS anomaly_score, s > 0.7::DOUBLE AS is_anomaly,
  round(abs(s - 0.5::DOUBLE) * 2, 9) AS confidence FROM (SELECT id, {s} AS s FROM three)"""


@plans.add("ensemble_mean", sql(LOGS, THREE, MEAN.format(
    s="(a + coalesce(b, 0) + coalesce(c, 0)) / (1 + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT)")))
def _(spark, d):
    return verdict(scoring.ensemble(normalised(spark, d)))


LONG = """long AS (SELECT id, unnest(['isolation_forest', 'one_class_svm', 'local_outlier_factor']) AS model,
  unnest([a, b, c]) AS score FROM three)"""


def long_scores(spark, d):
    return normalised(spark, d).unpivot("id", list(scoring.MODELS), "model", "score")


@plans.add("ensemble_mean_long", sql(LOGS, THREE, LONG, """SELECT id, round(s, 9) AS anomaly_score, s > 0.7::DOUBLE AS is_anomaly,
  round(abs(s - 0.5::DOUBLE) * 2, 9) AS confidence FROM (SELECT id, avg(score) AS s FROM long GROUP BY id)"""))
def _(spark, d):
    return verdict(scoring.ensemble_long(long_scores(spark, d)))


@plans.add("ensemble_weighted", sql(LOGS, THREE, MEAN.format(
    s="(0.4::DOUBLE * a + coalesce(0.3::DOUBLE * b, 0) + coalesce(0.3::DOUBLE * c, 0)) / (0.4::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.3::DOUBLE END)")))
def _(spark, d):
    return verdict(scoring.ensemble(normalised(spark, d), weights=scoring.WEIGHTS_THREE))


@plans.add("ensemble_weighted_two", sql(LOGS, THREE, MEAN.format(
    s="(0.6::DOUBLE * a + coalesce(0.4::DOUBLE * b, 0)) / (0.6::DOUBLE + CASE WHEN b IS NULL THEN 0 ELSE 0.4::DOUBLE END)")))
def _(spark, d):
    return verdict(scoring.ensemble(normalised(spark, d), weights=scoring.WEIGHTS_TWO))


@plans.add("classify_anomaly", sql(LOGS, TYPES, "SELECT id, anomaly_type FROM typed"))
def _(spark, d):
    return scoring.classify_anomaly(logs(spark, d)).select("id", "anomaly_type")


@plans.add("anomaly_reasons", sql(LOGS, f"""r AS (SELECT id, list_filter([
  CASE WHEN level IN ('ERROR', 'FATAL') THEN 'High severity log level: ' || level END,
  CASE WHEN duration_ms > 5000 THEN 'High response time: ' || duration_ms || 'ms' END,
  CASE WHEN http_status >= 500 THEN 'Server error status: ' || http_status
    WHEN http_status >= 400 THEN 'Client error status: ' || http_status END,
  CASE WHEN {SECURITY} THEN 'Security-related error detected' END,
  CASE WHEN k % 2 = 0 THEN 'Flagged by models: isolation_forest' || CASE WHEN k % 3 = 0 THEN ', one_class_svm' ELSE '' END
    WHEN k % 3 = 0 THEN 'Flagged by models: one_class_svm' END], lambda x: x IS NOT NULL) AS r FROM logs)""",
    """SELECT id, CASE WHEN len(r) = 0 THEN 'Statistical anomaly detected by ML models'
    ELSE array_to_string(r, '; ') END AS anomaly_reasons FROM r"""))
def _(spark, d):
    k = F.col("line_number") / 5
    flags = {"isolation_forest": k % 2 == 0, "one_class_svm": k % 3 == 0}
    return scoring.with_reasons(logs(spark, d), flags).select("id", joined("anomaly_reasons").alias("anomaly_reasons"))


@plans.add("recommendations", sql(LOGS, TYPES, HEURISTIC, f"""SELECT id, {ADVICE.format(s='anomaly_score', t='anomaly_type')} AS recommendations
  FROM (SELECT t.*, h.anomaly_score FROM typed t JOIN heuristic h ON t.id = h.id)"""))
def _(spark, d):
    typed = scoring.score_heuristic(logs(spark, d)).withColumn("anomaly_type", scoring.anomaly_type())
    advice = scoring.recommendations(F.col("service_name"), F.col("anomaly_type"), F.col("anomaly_score"))
    return typed.select("id", joined(advice).alias("recommendations"))


@plans.add("result_metadata", sql(LOGS, THREE, """SELECT id, 'isolation_forest,local_outlier_factor,one_class_svm' AS models,
  (a > 0.7::DOUBLE) AS isolation_forest_flag, round(b, 9) AS one_class_svm_score, 12::INTEGER AS feature_count,
  'f0,f1,f2,f3,f4,f5,f6,f7,f8,f9,f10,f11' AS features_analyzed FROM three"""))
def _(spark, d):
    base = logs(spark, d).join(normalised(spark, d), "id")
    flagged = base.withColumns({f"{m}_flag": F.col(m) > F.lit(0.7) for m in scoring.MODELS})
    out = scoring.assemble_results(flagged, [f"f{i}" for i in range(12)])
    return out.select(
        "id",
        F.array_join(F.array_sort(F.map_keys("individual_scores")), ",").alias("models"),
        F.col("model_predictions")["isolation_forest"].alias("isolation_forest_flag"),
        F.round(F.col("individual_scores")["one_class_svm"], 9).alias("one_class_svm_score"),
        "feature_count",
        F.array_join("features_analyzed", ",").alias("features_analyzed"),
    )


@plans.add("runtime_threshold", sql(LOGS, HEURISTIC, """SELECT id, anomaly_score > 0.35::DOUBLE AS is_anomaly FROM heuristic"""))
def _(spark, d):
    return scoring.score_heuristic(logs(spark, d), threshold=0.35).select("id", "is_anomaly")


@plans.add("threshold_from_table", sql(LOGS, HEURISTIC, """SELECT id, anomaly_score > (SELECT count(*) FROM region) / 20::DOUBLE AS is_anomaly,
  (SELECT count(*) FROM region) / 20::DOUBLE AS threshold_used FROM heuristic"""))
def _(spark, d):
    """The threshold is looked up in a settings table, here one made from ``region``."""
    region = spark.read.parquet(f"{d}/region.parquet")
    config = region.agg((F.count("*") / F.lit(20.0)).alias("value")).withColumn("name", F.lit("anomaly_threshold"))
    threshold = scoring.setting(config, "anomaly_threshold", scoring.MODEL_THRESHOLD)
    return scoring.score_heuristic(logs(spark, d), threshold).select("id", "is_anomaly", "threshold_used")


@plans.add("prediction_counts", sql(LOGS, HEURISTIC, """SELECT CASE WHEN is_anomaly THEN 'anomaly' ELSE 'normal' END AS prediction,
  count(*) AS predictions FROM heuristic GROUP BY 1"""))
def _(spark, d):
    return scoring.prediction_counts(heuristic(spark, d))
