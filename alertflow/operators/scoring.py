"""Rule scores, result joins, ensembles, anomaly types, reasons and recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.functions import rules

DETECTOR_THRESHOLD = 0.8
MODEL_THRESHOLD = 0.7
MODEL_VERSION = "1.0.0"
SLOW_MS = 5000

# Default scores by level and the text that goes with them.
DEFAULT_SCORES = {"ERROR": 0.7, "FATAL": 0.7, "WARN": 0.4}
DEFAULT_REASON = "AI service unavailable, default scoring applied"
# Heuristic increments.
HEURISTIC_LEVEL = {"ERROR": 0.7, "FATAL": 0.9, "WARN": 0.4}
HEURISTIC_LEVEL_TEXT = {"ERROR": "Error level log", "FATAL": "Fatal level log", "WARN": "Warning level log"}
# Words that mark a message as security related.
SECURITY_WORDS = ("auth", "login", "password", "token", "security", "attack", "injection")
# Advice per anomaly type; the first line of error_spike names the service.
ADVICE = {
    "error_spike": (
        "Investigate {service} service health",
        "Check recent deployments or configuration changes",
        "Monitor error rates and patterns",
    ),
    "performance_degradation": (
        "Check resource utilization (CPU, memory, disk)",
        "Analyze database query performance",
        "Review network connectivity",
    ),
    "security_threat": (
        "Review authentication logs",
        "Check for potential security breaches",
        "Verify user permissions and access patterns",
    ),
}
OTHER_ADVICE = (
    "Monitor service for similar patterns",
    "Check service dependencies",
    "Review application logs for context",
)
URGENT_ADVICE = "HIGH PRIORITY: Immediate investigation required"

# Model names in vote order and the two declared weightings.
MODELS = ("isolation_forest", "one_class_svm", "local_outlier_factor")
WEIGHTS_THREE = {"isolation_forest": 0.4, "one_class_svm": 0.3, "local_outlier_factor": 0.3}
WEIGHTS_TWO = {"isolation_forest": 0.6, "one_class_svm": 0.4}

_NO_REASONS = "array<string>"
_NO_FEATURES = "map<string,double>"


Threshold = float | Column


def _number(value: Threshold) -> Column:
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def setting(config: DataFrame, name: str, default: float) -> Column:
    """Value of a (name, value) settings table as a scalar, read when the query runs.

    Built inside ``foreachBatch`` it picks up a changed setting with the next batch.
    """
    found = config.filter(F.col("name") == name).agg(F.max("value").cast("double"))
    return F.coalesce(found.scalar(), F.lit(float(default)))


def _empty_features() -> Column:
    return F.create_map().cast(_NO_FEATURES)


def to_ml_schema(logs: DataFrame) -> DataFrame:
    """Collector record to scoring record."""
    return logs.select(
        F.col("id").alias("log_id"),
        F.col("event_ts").alias("timestamp"),
        "service_name",
        "hostname",
        F.upper("level").alias("log_level"),
        "message",
        *[
            c
            for c in (
                "thread", "logger", "method", "line_number", "exception", "stack_trace", "user_id", "session_id",
                "request_id", "http_method", "http_status", "endpoint", "duration_ms", "metadata",
            )
            if c in logs.columns
        ],
    )


# Texts of the reasons.
REASON = {
    "exception": "Exception present", "server_error": "Server error: ", "slow": "High response time",
    "level": "High severity log level: ", "server_status": "Server error status: ",
    "client_status": "Client error status: ", "models": "Flagged by models: ",
    "none": "Statistical anomaly detected by ML models",
}


def _default_columns(threshold: Threshold) -> dict[str, Column]:
    score = rules.lookup(F.col("level"), DEFAULT_SCORES, 0.1)
    return {
        "anomaly_score": score,
        "anomaly_reasons": F.array(F.lit(DEFAULT_REASON)),
        "feature_scores": _empty_features(),
        "is_anomaly": score > _number(threshold),
        "anomaly_type": F.lit("default"),
    }


def score_default(logs: DataFrame, threshold: Threshold = DETECTOR_THRESHOLD) -> DataFrame:
    """Score by level alone; the event time stands in for the scoring clock."""
    return logs.withColumns({**_default_columns(threshold), "scored_at": F.col("event_ts")})


def _result_struct(threshold: Threshold) -> Column:
    score = F.coalesce(F.col("anomaly_score"), F.lit(0.0))
    return F.struct(
        score.alias("anomaly_score"),
        F.coalesce(F.col("anomaly_reasons"), F.array().cast(_NO_REASONS)).alias("anomaly_reasons"),
        F.coalesce(F.col("feature_scores"), _empty_features()).alias("feature_scores"),
        (score > _number(threshold)).alias("is_anomaly"),
        F.coalesce(F.col("anomaly_type"), F.lit("unknown")).alias("anomaly_type"),
    )


def _join_results(logs: DataFrame, results: DataFrame, threshold: Threshold) -> DataFrame:
    """A second answer for a log must not repeat the log: the highest score wins, then the type."""
    answer = results.groupBy("id").agg(
        F.max_by(_result_struct(threshold), F.struct("anomaly_score", "anomaly_type")).alias("_r")
    )
    return logs.join(answer, "id", "left")


def attach_scores(logs: DataFrame, results: DataFrame, threshold: Threshold = DETECTOR_THRESHOLD) -> DataFrame:
    """Join model answers; fields an answer leaves out take neutral values.

    ``results`` has id, anomaly_score, anomaly_reasons,
    feature_scores and anomaly_type, each nullable.
    """
    neutral = F.struct(
        F.lit(0.0).alias("anomaly_score"),
        F.array().cast(_NO_REASONS).alias("anomaly_reasons"),
        _empty_features().alias("feature_scores"),
        (F.lit(0.0) > _number(threshold)).alias("is_anomaly"),
        F.lit("unknown").alias("anomaly_type"),
    )
    joined = _join_results(logs, results, threshold).withColumn("_r", F.coalesce("_r", neutral))
    return joined.select(*logs.columns, "_r.*", F.col("event_ts").alias("scored_at"))


def score_with_fallback(logs: DataFrame, results: DataFrame, threshold: Threshold = DETECTOR_THRESHOLD) -> DataFrame:
    """Model answer where there is one, level default where there is none."""
    default = F.struct(*[c.alias(n) for n, c in _default_columns(threshold).items()])
    joined = _join_results(logs, results, threshold).withColumn("_r", F.coalesce("_r", default))
    return joined.select(*logs.columns, "_r.*", F.col("event_ts").alias("scored_at"))


def _said(col: str) -> Column:
    """True for a non-empty text."""
    return F.coalesce(F.col(col) != "", F.lit(False))


def score_heuristic(logs: DataFrame, threshold: Threshold = MODEL_THRESHOLD, version: str = MODEL_VERSION) -> DataFrame:
    """Additive rule score, used when no model has answered."""
    level, status, duration = F.col("level"), F.col("http_status"), F.col("duration_ms")
    server_error = F.coalesce(status >= 500, F.lit(False))
    slow = F.coalesce(duration > SLOW_MS, F.lit(False))
    zero = F.lit(0.0)
    total = (
        rules.lookup(level, HEURISTIC_LEVEL, 0.0)
        + F.when(_said("exception"), F.lit(0.3)).otherwise(zero)
        + F.when(server_error, F.lit(0.4)).otherwise(zero)
        + F.when(slow, F.lit(0.3)).otherwise(zero)
    )
    score = F.least(total, F.lit(1.0))
    kind = F.when(level.isin("ERROR", "FATAL"), F.lit("error_spike")).when(
        slow, F.lit("performance_degradation")
    ).otherwise(F.lit("unknown"))
    reasons = rules.present(
        rules.lookup(level, HEURISTIC_LEVEL_TEXT, None),
        F.when(_said("exception"), F.lit(REASON["exception"])),
        F.when(server_error, F.concat(F.lit(REASON["server_error"]), status.cast("string"))),
        F.when(slow, F.lit(REASON["slow"])),
    )
    scored = logs.withColumns({"anomaly_score": score, "_kind": kind, "_reasons": reasons})
    flagged = F.col("anomaly_score") > _number(threshold)
    scored = scored.withColumns(
        {
            "is_anomaly": flagged,
            "confidence": F.lit(0.6),
            "anomaly_type": F.when(flagged, F.col("_kind")),
            "anomaly_reasons": F.when(flagged, F.col("_reasons")).otherwise(F.array().cast(_NO_REASONS)),
            "feature_scores": _empty_features(),
            "features_analyzed": F.array(F.lit("heuristic_rules")),
            "model_version": F.lit(f"{version}_fallback"),
            "threshold_used": _number(threshold),
            "recommendations": recommendations(F.col("service_name"), F.col("_kind"), F.col("anomaly_score")),
            "result_metadata": F.create_map(F.lit("scoring_method"), F.lit("heuristic_fallback")),
            "scored_at": F.col("event_ts"),
        }
    )
    return scored.drop("_kind", "_reasons")


def normalise(raw: Column) -> Column:
    """Raw model score to [0, 1]; more negative means more anomalous."""
    return rules.clamp(F.lit(0.5) - raw, 0.0, 1.0)


def rank_normalise(scored: DataFrame, raw: str, out: str, steps: int = 1000, accuracy: int = 10_000) -> DataFrame:
    """Optional alternative to :func:`normalise` that does not saturate.

    Every score is placed among ``steps`` quantiles of the whole column. The
    quantile list has a fixed length and is the only thing that travels.
    """
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    cuts = scored.agg(F.percentile_approx(F.col(raw), grid, accuracy)).scalar()
    below = F.size(F.filter(F.col("_cuts"), lambda c: c > F.col(raw)))
    return (
        scored.withColumn("_cuts", cuts)
        .withColumn(out, rules.clamp(below.cast("double") / F.lit(float(steps)), 0.0, 1.0))
        .drop("_cuts")
    )


def ensemble(
    wide: DataFrame,
    models: Sequence[str] = MODELS,
    threshold: Threshold = MODEL_THRESHOLD,
    weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Mean (or weighted mean) of the model score columns present in a row; no shuffle.

    A null column means that model gave no answer; with no answer at all the
    score is 0.5.
    """
    used = [m for m in models if weights is None or m in weights]
    w = {m: 1.0 if weights is None else float(weights[m]) for m in used}
    zero = F.lit(0.0)
    total = weight = zero
    for m in used:
        total = total + F.coalesce(F.col(m) * F.lit(w[m]), zero)
        weight = weight + F.when(F.col(m).isNotNull(), F.lit(w[m])).otherwise(zero)
    score = F.when(weight > 0, total / weight).otherwise(F.lit(0.5))
    return _with_verdict(wide.withColumn("anomaly_score", score), threshold)


def ensemble_long(
    scores: DataFrame, threshold: Threshold = MODEL_THRESHOLD, weights: Mapping[str, float] | None = None
) -> DataFrame:
    """Same over (id, model, score) rows; one map-side combined aggregate."""
    if weights is None:
        score = F.avg("score")
    else:
        w = rules.lookup(F.col("model"), {k: float(v) for k, v in weights.items()}, 0.0)
        known = F.when(F.col("score").isNotNull(), w)
        score = F.sum(F.col("score") * w) / F.nullif(F.sum(known), F.lit(0.0))
    out = scores.groupBy("id").agg(F.coalesce(score, F.lit(0.5)).alias("anomaly_score"))
    return _with_verdict(out, threshold)


def _with_verdict(df: DataFrame, threshold: Threshold) -> DataFrame:
    s = F.col("anomaly_score")
    return df.withColumns(
        {
            "is_anomaly": s > _number(threshold),
            "confidence": F.abs(s - F.lit(0.5)) * F.lit(2.0),
            "threshold_used": _number(threshold),
        }
    )


def _security_hit() -> Column:
    text = F.lower("message")
    hit = F.lit(False)
    for word in SECURITY_WORDS:
        hit = hit | text.contains(word)
    return F.coalesce(hit & F.col("level").isin("ERROR", "WARN"), F.lit(False))


def anomaly_type() -> Column:
    """Latest matching rule wins, so the CASE lists the rules from last to first."""
    status, level = F.col("http_status"), F.col("level")
    raised = F.lower("message").contains("exception") | _said("exception")
    return (
        F.when(_security_hit(), F.lit("security_threat"))
        .when(status >= 500, F.lit("error_spike"))
        .when(status >= 400, F.lit("security_threat"))
        .when(F.col("duration_ms") > SLOW_MS, F.lit("performance_degradation"))
        .when(level.isin("ERROR", "FATAL"), F.when(raised, F.lit("error_spike")).otherwise(F.lit("unusual_pattern")))
        .otherwise(F.lit("unknown"))
    )


def classify_anomaly(logs: DataFrame) -> DataFrame:
    return logs.withColumn("anomaly_type", anomaly_type())


def anomaly_reasons(flags: Mapping[str, Column] | None = None) -> Column:
    """Reasons in rule order, then the models that flagged the row."""
    level, status, duration = F.col("level"), F.col("http_status"), F.col("duration_ms")
    status_text = status.cast("string")
    items = [
        F.when(level.isin("ERROR", "FATAL"), F.concat(F.lit(REASON["level"]), level)),
        F.when(duration > SLOW_MS, F.concat(F.lit(REASON["slow"] + ": "), rules.plain_double(duration), F.lit("ms"))),
        F.when(status >= 500, F.concat(F.lit(REASON["server_status"]), status_text)).when(
            status >= 400, F.concat(F.lit(REASON["client_status"]), status_text)
        ),
        F.when(_security_hit(), F.lit("Security-related error detected")),
    ]
    if flags:
        names = rules.present(*[F.when(flag, F.lit(name)) for name, flag in flags.items()])
        items.append(F.when(F.size(names) > 0, F.concat(F.lit(REASON["models"]), F.array_join(names, ", "))))
    found = rules.present(*items)
    nothing = F.array(F.lit(REASON["none"]))
    return F.when(F.size(found) == 0, nothing).otherwise(found)


def with_reasons(logs: DataFrame, flags: Mapping[str, Column] | None = None) -> DataFrame:
    return logs.withColumn("anomaly_reasons", anomaly_reasons(flags))


def recommendations(service: Column, kind: Column, score: Column) -> Column:
    def lines(texts: Sequence[str]) -> Column:
        return F.array(*[rules.template(t.replace("{service}", "{{ service }}"), {"service": service}) for t in texts])

    advice = lines(OTHER_ADVICE)
    for name, texts in ADVICE.items():
        advice = F.when(kind == name, lines(texts)).otherwise(advice)
    urgent = F.when(score > F.lit(0.9), F.array(F.lit(URGENT_ADVICE))).otherwise(F.array().cast(_NO_REASONS))
    return F.concat(urgent, advice)


def assemble_results(
    scored: DataFrame,
    feature_names: Sequence[str],
    models: Sequence[str] = MODELS,
    threshold: Threshold = MODEL_THRESHOLD,
    version: str = MODEL_VERSION,
    feature_count: int | None = None,
) -> DataFrame:
    """Full result record: verdict, type, reasons, advice and per-model detail.

    ``scored`` is a log table with one normalised score column per model and a
    boolean ``<model>_flag`` next to it.
    """
    flags = {m: F.coalesce(F.col(f"{m}_flag"), F.lit(False)) for m in models}
    out = ensemble(scored, models, threshold)
    return out.withColumns(
        {
            "anomaly_type": anomaly_type(),
            "anomaly_reasons": anomaly_reasons(flags),
            "recommendations": recommendations(F.col("service_name"), anomaly_type(), F.col("anomaly_score")),
            "features_analyzed": F.lit(list(feature_names)),
            "model_version": F.lit(version),
            "model_predictions": F.create_map(*[x for m in models for x in (F.lit(m), flags[m])]),
            "individual_scores": F.create_map(*[x for m in models for x in (F.lit(m), F.col(m))]),
            "feature_count": F.lit(feature_count if feature_count is not None else len(feature_names)),
        }
    )


def prediction_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy(
        F.when(F.col("is_anomaly"), F.lit("anomaly")).otherwise(F.lit("normal")).alias("prediction")
    ).agg(F.count("*").alias("predictions"))
