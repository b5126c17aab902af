"""Feature queries over logs and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.functions import text
from alertflow.operators import features
from alertflow.plans.registry import Plans
from alertflow.plans.tables import LOGS, logs, sql, table

plans = Plans()
# A short list given to both engines; callers pass their own.
STOP = ("the", "of", "in", "to", "for", "is", "and", "with", "by", "that")
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


@plans.add("basic_features", sql(LOGS, """SELECT id, CASE level WHEN 'TRACE' THEN 0 WHEN 'DEBUG' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARN' THEN 3
  WHEN 'ERROR' THEN 4 WHEN 'FATAL' THEN 5 ELSE 2 END::INTEGER AS log_level_severity, length(message)::INTEGER AS message_length,
  (exception IS NOT NULL)::INTEGER AS has_exception, (stack_trace IS NOT NULL)::INTEGER AS has_stack_trace,
  CASE WHEN http_status >= 500 THEN 4 WHEN http_status >= 400 THEN 3 WHEN http_status >= 300 THEN 2 WHEN http_status >= 200 THEN 1 ELSE 0 END::INTEGER
  AS http_status_category FROM logs"""))
def _(spark, d):
    return logs(spark, d).select("id", *[c.alias(n) for n, c in features.basic_features().items()])


def clean_sql(col):
    out = f"coalesce({col}, '')"
    for pattern, tag in (
        (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "IP_ADDRESS"),
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "EMAIL"),
        (r"https?://[a-z!$-_]+", "URL"),
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "UUID"),
        (r"\b\d+\b", "NUMBER"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '<{tag}>', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@plans.add("clean_message", sql(LOGS, f"SELECT id, {clean_sql('message')} AS cleaned FROM logs"))
def _(spark, d):
    return logs(spark, d, True).select("id", text.clean_text(F.col("message")).alias("cleaned"))


def tfidf_sql(source, id_col):
    """Terms, vocabulary and weights of ``source`` ({id_col}, cleaned)."""
    return f"""words AS (SELECT {id_col}, list_filter(regexp_extract_all(strip_accents(lower(cleaned)), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM {source}),
  terms AS (SELECT {id_col}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
  tf AS (SELECT {id_col}, term, count(*) AS tf FROM terms GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM {source}),
  dfs AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
  vocabulary AS (SELECT term, df, ln((1 + (SELECT n FROM n))::DOUBLE / (1 + df)) + 1 AS idf FROM dfs
    WHERE df >= 2 AND df <= 0.95::DOUBLE * (SELECT n FROM n)),
  raw AS (SELECT {id_col}, term, tf * idf AS w FROM tf JOIN vocabulary USING (term)),
  weights AS (SELECT {id_col}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {id_col})) AS weight FROM raw)"""


def log_text(spark, d):
    return logs(spark, d, True).select("id", text.clean_text(F.col("message")).alias("cleaned"))


LOG_TEXT = f"src AS (SELECT id, {clean_sql('message')} AS cleaned FROM logs)"


@plans.add("tfidf_logs", sql(LOGS, LOG_TEXT, tfidf_sql("src", "id"), "SELECT id, term, round(weight, 6) AS weight FROM weights"))
def _(spark, d):
    src = log_text(spark, d)
    vocabulary = features.fit_vocabulary(src, "id", "cleaned", STOP)
    return features.tfidf(src, vocabulary, "id", "cleaned", STOP).select("id", "term", F.round("weight", 6).alias("weight"))


@plans.add("vocabulary_logs", sql(LOGS, LOG_TEXT, tfidf_sql("src", "id"), """SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx,
  df, round(idf, 6) AS idf FROM vocabulary"""))
def _(spark, d):
    v = features.fit_vocabulary(log_text(spark, d), "id", "cleaned", STOP)
    return v.withColumn("idf", F.round("idf", 6))


# Masking is skipped for prose: its patterns are for log messages, and the two regex dialects
# disagree on word boundaries next to accented letters.
DOC_TEXT = "src AS (SELECT doc_id, text AS cleaned FROM documents)"


@plans.add("tfidf_documents", sql(DOC_TEXT, tfidf_sql("src", "doc_id"), """SELECT doc_id, count(*) AS terms, round(sum(weight), 5) AS total_weight,
  arg_max(term, weight) AS top_term, round(max(weight), 6) AS top_weight FROM (SELECT * FROM weights ORDER BY doc_id, weight DESC, term) GROUP BY doc_id""".replace(
    "arg_max(term, weight) AS top_term, ", "")))
def _(spark, d):
    docs = table(spark, d, "documents", True).select("doc_id", F.col("text").alias("cleaned"))
    vocabulary = features.fit_vocabulary(docs, "doc_id", "cleaned", STOP)
    return (
        features.tfidf(docs, vocabulary, "doc_id", "cleaned", STOP)
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("terms"),
            F.round(F.sum("weight"), 5).alias("total_weight"),
            F.round(F.max("weight"), 6).alias("top_weight"),
        )
    )


@plans.add("temporal_features", sql(LOGS, """SELECT id, hour(event_ts)::INTEGER AS hour_of_day, (isodow(event_ts) - 1)::INTEGER AS day_of_week,
  (isodow(event_ts) >= 6)::INTEGER AS is_weekend FROM logs"""))
def _(spark, d):
    return logs(spark, d).select("id", *[c.alias(n) for n, c in features.temporal_features().items()])


@plans.add("time_position", sql(LOGS, """t AS (SELECT id, epoch_us(event_ts) // 1000000 AS s FROM logs)""",
  """SELECT id, round((s - (SELECT min(s) FROM t)) / ((SELECT max(s) - min(s) FROM t) + 1e-8::DOUBLE), 6) AS time_since_epoch_norm FROM t"""))
def _(spark, d):
    rows = logs(spark, d)
    position = features.time_position(features.fit_statistics(rows))
    return rows.select("id", F.round(position, 6).alias("time_since_epoch_norm"))


CATEGORIES = """cats AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY v) - 1 AS i FROM (
  SELECT DISTINCT 'service_name' AS c, service_name AS v FROM fit UNION ALL SELECT DISTINCT 'hostname', hostname FROM fit
  UNION ALL SELECT DISTINCT 'level', level FROM fit UNION ALL SELECT 'logger', 'unknown')),
enc AS (SELECT id, coalesce((SELECT i FROM cats WHERE c = 'service_name' AND v = l.service_name), -1)::INTEGER AS service_name_encoded,
  coalesce((SELECT i FROM cats WHERE c = 'hostname' AND v = l.hostname), -1)::INTEGER AS hostname_encoded,
  coalesce((SELECT i FROM cats WHERE c = 'level' AND v = l.level), -1)::INTEGER AS level_encoded, 0::INTEGER AS logger_encoded FROM logs l)"""
FIT = "fit AS (SELECT * FROM logs WHERE level <> 'FATAL')"


def encoded(spark, d):
    """Categories fitted without FATAL rows, so that level is an unseen value at transform time."""
    rows = logs(spark, d)
    return features.encode_labels(rows, features.fit_categories(rows.filter("level <> 'FATAL'")))


@plans.add("label_encoding", sql(LOGS, FIT, CATEGORIES, "SELECT * FROM enc"))
def _(spark, d):
    return encoded(spark, d).select("id", *[f"{c}_encoded" for c in features.CATEGORICAL])


@plans.add("one_hot_encoding", sql(LOGS, FIT, CATEGORIES, """SELECT id, name || '_onehot_' || i AS feature, 1::DOUBLE AS value FROM (
  SELECT id, unnest(['service_name', 'hostname', 'level', 'logger']) AS name,
  unnest([service_name_encoded, hostname_encoded, level_encoded, logger_encoded]) AS i FROM enc) WHERE i >= 0"""))
def _(spark, d):
    return features.one_hot(encoded(spark, d))


@plans.add("standard_scaling", sql(LOGS, """s AS (SELECT avg(duration_ms) AS dm, stddev_pop(duration_ms) AS ds, avg(line_number) AS lm,
  stddev_pop(line_number) AS ls FROM logs)""", """SELECT id, round((duration_ms - dm) / ds, 6) AS duration_ms_scaled,
  round((line_number - lm) / ls, 6) AS line_number_scaled FROM logs, s"""))
def _(spark, d):
    rows = logs(spark, d)
    columns = features.scaled(features.fit_statistics(rows))
    return rows.select("id", *[F.round(c, 6).alias(n) for n, c in columns.items()])


PATTERNS = ", ".join(
    f"len(regexp_extract_all(message, '{p}'))::INTEGER AS pattern_{n}_count"
    for n, p in {
        "ip_address": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
        "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
        "url": r"https?://[a-z!$-_]+",
        "uuid": r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
        "number": r"\b\d+\b",
        "stack_trace": r"at\s+[\w.$]+\([\w.:]*\)",
        "exception": r"(?i)Exception|Error|Throwable",
    }.items()
)


@plans.add("pattern_counts", sql(LOGS, f"SELECT id, {PATTERNS} FROM (SELECT * REPLACE (message || coalesce(stack_trace, '') AS message) FROM logs)"))
def _(spark, d):
    rows = logs(spark, d).withColumn("message", F.concat("message", F.coalesce("stack_trace", F.lit(""))))
    return rows.select(
        "id", *[c.alias(n) for n, c in features.pattern_features().items() if n != "message_entropy"]
    )


ENTROPY = """chars AS (SELECT {i} AS i, unnest(regexp_extract_all({t}, '(?s).')) AS c, length({t}) AS n FROM {s}),
  freq AS (SELECT i, c, count(*) / any_value(n)::DOUBLE AS p FROM chars GROUP BY ALL),
  h AS (SELECT i, round(-sum(p * log2(p)), 6) AS message_entropy FROM freq GROUP BY i)"""


@plans.add("message_entropy", sql(LOGS, ENTROPY.format(i="id", t="message", s="logs"), "SELECT i AS id, message_entropy FROM h"))
def _(spark, d):
    return logs(spark, d, True).select("id", F.round(text.entropy(F.col("message")), 6).alias("message_entropy"))


@plans.add("document_entropy", sql(ENTROPY.format(i="doc_id", t="text", s="documents"), """SELECT doc_id,
  coalesce(message_entropy, 0) + 0 AS message_entropy FROM documents LEFT JOIN h ON i = doc_id"""))
def _(spark, d):
    docs = table(spark, d, "documents", True)
    return docs.select("doc_id", F.round(text.entropy(F.col("text")) + 0.0, 6).alias("message_entropy"))


@plans.add("fit_then_transform", sql(LOGS, "fit AS (SELECT * FROM logs WHERE event_ts < TIMESTAMP '2024-01-16 00:00:00')", """s AS (SELECT avg(duration_ms) AS dm,
  stddev_pop(duration_ms) AS ds, min(epoch_us(event_ts) // 1000000) AS lo, max(epoch_us(event_ts) // 1000000) AS hi FROM fit)""",
  """SELECT id, round((duration_ms - dm) / ds, 6) AS duration_ms_scaled, length(message)::DOUBLE AS message_length,
  round((epoch_us(event_ts) // 1000000 - lo) / (hi - lo + 1e-8::DOUBLE), 6) AS time_since_epoch_norm, 19::INTEGER AS n_features
  FROM logs, s WHERE event_ts >= TIMESTAMP '2024-01-16 00:00:00'"""))
def _(spark, d):
    rows = logs(spark, d, True)
    cut = F.to_timestamp_ntz(F.lit("2024-01-16 00:00:00"))
    fitted = features.fit_features(rows.filter(F.col("event_ts") < cut), with_text=False)
    out = features.transform_features(rows.filter(F.col("event_ts") >= cut), fitted)
    names = features.dense_names()
    at = lambda n: F.col("features")[names.index(n)]
    return features.feature_vector(out).select(
        "id", F.round(at("duration_ms_scaled"), 6).alias("duration_ms_scaled"), at("message_length").alias("message_length"),
        F.round(at("time_since_epoch_norm"), 6).alias("time_since_epoch_norm"), F.size("features").alias("n_features"),
    )


@plans.add("feature_importance", sql(LOGS, "SELECT level AS feature_name, round(1::DOUBLE / (SELECT count(DISTINCT level) FROM logs), 9) AS importance_score FROM (SELECT DISTINCT level FROM logs)"))
def _(spark, d):
    names = logs(spark, d).select(F.col("level").alias("feature_name")).distinct()
    return features.equal_importance(names).withColumn("importance_score", F.round("importance_score", 9))


ROLL = ", ".join(
    f"count(*) OVER w{m} AS count_{m}m, round(avg(duration_ms) OVER w{m}, 5) AS mean_{m}m, round(stddev_samp(duration_ms) OVER w{m}, 5) AS std_{m}m, round(max(duration_ms) OVER w{m}, 5) AS max_{m}m"
    for m in features.WINDOWS_MINUTES
)
FRAMES = ", ".join(
    f"w{m} AS (PARTITION BY service_name ORDER BY event_ts RANGE BETWEEN INTERVAL {m} MINUTE PRECEDING AND CURRENT ROW)"
    for m in features.WINDOWS_MINUTES
)


@plans.add("rolling_features", sql(LOGS, f"SELECT id, {ROLL} FROM logs WINDOW {FRAMES}"))
def _(spark, d):
    out = features.rolling_features(logs(spark, d))
    kept = [c for c in out.columns if c.endswith("m") and c.split("_")[0] in ("count", "mean", "std", "max")]
    return out.select("id", *[F.col(c) if c.startswith("count") else F.round(c, 5).alias(c) for c in kept])


@plans.add("median_imputation", sql(LOGS, """g AS (SELECT id, CASE WHEN k % 3 <> 0 THEN duration_ms END AS duration_ms, CASE WHEN k % 4 <> 0 THEN line_number END AS line_number FROM logs),
  m AS (SELECT quantile_cont(duration_ms, 0.5) AS d, quantile_cont(line_number, 0.5) AS l FROM g)""",
  """SELECT id, round(coalesce(duration_ms, d), 6) AS duration_ms, coalesce(line_number, l)::DOUBLE AS line_number FROM g, m"""))
def _(spark, d):
    k = F.col("line_number") / 5
    holes = logs(spark, d).select(
        "id", F.when(k % 3 != 0, F.col("duration_ms")).alias("duration_ms"),
        F.when(k % 4 != 0, F.col("line_number")).alias("line_number"),
    )
    return features.impute_median(holes, features.fit_medians(holes)).withColumn("duration_ms", F.round("duration_ms", 6))


TEMPLATES = f"""t AS (SELECT *, {clean_sql('message')} AS template FROM logs),
  counts AS (SELECT service_name, template, count(*) AS logs, min(event_ts) AS first_seen, max(event_ts) AS last_seen FROM t GROUP BY ALL)"""


@plans.add("top_templates", sql(LOGS, TEMPLATES, """SELECT service_name, template, logs, first_seen, last_seen, r::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY service_name ORDER BY logs DESC, template) AS r FROM counts) WHERE r <= 5"""))
def _(spark, d):
    return features.top_templates(logs(spark, d))


@plans.add("similar_patterns", sql(LOGS, TEMPLATES, """SELECT id, c.logs AS template_logs, event_ts > first_seen AS similar_seen_before
  FROM t JOIN counts c ON t.service_name = c.service_name AND t.template = c.template"""))
def _(spark, d):
    return features.seen_before(logs(spark, d)).select("id", "template_logs", "similar_seen_before")
