"""Model queries over logs, embeddings, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertflow.operators import alerts, features, incidents, neighbours, novelty, scoring, suppress
from alertflow.plans.registry import Plans
from alertflow.plans.tables import LOGS, logs, sql, table
from alertflow.session import new_folder

plans = Plans()


def sampled_sql(source, k, name="support"):
    return f"{name} AS (SELECT * FROM {source} ORDER BY md5(id || ':42'), id LIMIT {k})"


@plans.add("training_subset", sql(LOGS, sampled_sql("logs", 500), "SELECT id FROM support"))
def _(spark, d):
    return novelty.bounded_sample(logs(spark, d).select("id"), 500)


def simple_vectors(spark, d):
    """Three plain numbers per log, for the models that have a SQL counterpart."""
    return logs(spark, d, True).select(
        "id",
        F.array(
            F.col("duration_ms") / 1000.0, F.col("line_number") / 100.0, F.hour("event_ts").cast("double")
        ).alias("features"),
    )


SIMPLE = "v AS (SELECT id, [duration_ms / 1000, line_number / 100, hour(event_ts)::DOUBLE] AS f FROM logs)"
DRAW = "CAST('0x' || substr({0}, {1}, 13) AS BIGINT)"


def draw(text: str, start: int) -> str:
    """A whole number below 2^52 from 13 hex digits of a digest."""
    return DRAW.format(f"md5({text})", start)


SHARE = novelty.SPAN
W = "'42:' || j || ':' || i"
KERNEL = f"""g AS (SELECT 1 / (3 * var_pop(x)) AS gamma FROM (SELECT unnest(f) AS x FROM v)),
  w AS (SELECT j, list(sqrt(-2 * ln(({draw(W, 1)} + 1) / {SHARE}::DOUBLE)) * cos(2 * pi() * ({draw(W, 14)} / {SHARE}::DOUBLE)) * sqrt(2 * gamma) ORDER BY i) AS w
    FROM range({novelty.FREQUENCIES}) a(j), range(3) b(i), g GROUP BY j),
  turns AS (SELECT id, j, w[1] * f[1] + w[2] * f[2] + w[3] * f[3] AS turn FROM v, w),
  sums AS (SELECT j, avg(cos(turn)) AS c, avg(sin(turn)) AS s FROM turns GROUP BY j),
  kernel AS (SELECT id, avg(cos(turn) * c + sin(turn) * s) AS raw FROM turns JOIN sums USING (j) GROUP BY id)"""


def kernel_scores(spark, d):
    v = simple_vectors(spark, d)
    return novelty.with_raw_scores(v, {"one_class_svm": novelty.fit_kernel(v)}, "raw_").select("id", "raw_one_class_svm")


@plans.add("kernel_novelty", sql(LOGS, SIMPLE, KERNEL, """SELECT id, round(raw, 6) AS raw,
  round(greatest(0, least(1, 0.5::DOUBLE - raw)), 6) AS score FROM kernel"""))
def _(spark, d):
    from alertflow.operators.scoring import normalise

    raw = F.col("raw_one_class_svm")
    return kernel_scores(spark, d).select("id", F.round(raw, 6).alias("raw"), F.round(normalise(raw), 6).alias("score"))


@plans.add("contamination_threshold", sql(LOGS, SIMPLE, KERNEL,
  "SELECT 'one_class_svm' AS model, round(quantile_cont(raw, 0.1), 6) AS threshold FROM kernel"))
def _(spark, d):
    scored = kernel_scores(spark, d).withColumnRenamed("raw_one_class_svm", "one_class_svm")
    cut = novelty.contamination_threshold(scored, ["one_class_svm"])
    return cut.withColumn("threshold", F.round("threshold", 6))


@plans.add("model_flags", sql(LOGS, SIMPLE, KERNEL,
  "SELECT id, raw < (SELECT quantile_cont(raw, 0.1) FROM kernel) AS one_class_svm_flag FROM kernel"))
def _(spark, d):
    scored = kernel_scores(spark, d)
    cut = novelty.contamination_threshold(scored.withColumnRenamed("raw_one_class_svm", "one_class_svm"), ["one_class_svm"])
    flagged = novelty.flag_models(scored, cut, ["one_class_svm"])
    return flagged.select("id", "one_class_svm_flag")


def embedding_vectors(spark, d):
    e = table(spark, d, "embeddings", True)
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


LOF = """near AS (SELECT a.id, b.id AS other, list_distance(a.f, b.f) AS d,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS r FROM v a JOIN v b ON a.id <> b.id QUALIFY r <= 20),
  kd AS (SELECT id, max(d) AS kd FROM near GROUP BY id),
  lrd AS (SELECT n.id, 1 / (avg(greatest(d, kd.kd)) + 1e-10::DOUBLE) AS lrd FROM near n JOIN kd ON kd.id = n.other GROUP BY n.id),
  seen AS (SELECT v.id, s.id AS other, list_distance(v.f, s.f) AS d,
    row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.f, s.f), s.id) AS r FROM v, v s QUALIFY r <= 20),
  lof AS (SELECT s.id, -avg(lrd.lrd) * (avg(greatest(d, kd.kd)) + 1e-10::DOUBLE) AS raw FROM seen s JOIN kd ON kd.id = s.other JOIN lrd ON lrd.id = s.other GROUP BY s.id)"""
EMBEDDED = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS f FROM embeddings)"


@plans.add("local_outlier_factor", sql(EMBEDDED, LOF, "SELECT id, round(raw, 5) AS raw FROM lof"))
def _(spark, d):
    """Fitted on every row, and every row scored."""
    _, scored = novelty.lof_of_all(embedding_vectors(spark, d))
    return scored.select("id", F.round("raw", 5).alias("raw"))


@plans.add("nearest_neighbours", sql(EMBEDDED, """near AS (SELECT a.id, b.id AS other, round(list_distance(a.f, b.f), 6) AS d,
    (row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id))::INTEGER AS rank FROM v a, v b QUALIFY rank <= 5)""", "SELECT * FROM near"))
def _(spark, d):
    """The five nearest rows of every row, itself among them, over cells of some fifty rows."""
    v = embedding_vectors(spark, d).select("id", "features")
    return neighbours.knn_join(v, v, 5, cell_rows=50, block=32).select("id", "other", F.round("d", 6).alias("d"), "rank")


N = "'42:' || tree || ':' || node"
SPLIT = f"""SELECT *, usable[{draw(N, 14)} % nullif(len(usable), 0) + 1] AS feature, {draw(N, 1)} / {SHARE}::DOUBLE AS share
      FROM (SELECT *, list_filter([1, 2, 3], lambda i: n >= 2 AND depth < lim AND highs[i] > lows[i]) AS usable
        FROM (SELECT *, (SELECT lim FROM size) AS lim FROM"""
NORM = "CASE WHEN {0} > 2 THEN 2 * (ln({0} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({0} - 1) / {0}::DOUBLE WHEN {0} = 2 THEN 1::DOUBLE ELSE 0::DOUBLE END"
FOREST = (
    f"draws AS (SELECT id, f, {draw("id || ':42'", 1)} AS h FROM v)",
    f"""drawn AS (SELECT tree, id, f FROM draws, range({novelty.TREES}) t(tree)
    QUALIFY row_number() OVER (PARTITION BY tree ORDER BY (h + tree * {novelty.STEP}) % {SHARE}, id) <= {novelty.TREE_SAMPLE})""",
    "size AS (SELECT least(count(*), 256) AS n, ceil(log2(greatest(least(count(*), 256), 2))) AS lim FROM v)",
    f"""m AS (SELECT tree, 1::BIGINT AS node, 0 AS depth, id, f FROM drawn
    UNION ALL
    SELECT tree, 2 * node + (f[feature] > lows[feature] + share * (highs[feature] - lows[feature]))::INT, depth + 1, id, f
    FROM ({SPLIT} (SELECT *, count(*) OVER w AS n, [min(f[1]) OVER w, min(f[2]) OVER w, min(f[3]) OVER w] AS lows,
      [max(f[1]) OVER w, max(f[2]) OVER w, max(f[3]) OVER w] AS highs FROM m WINDOW w AS (PARTITION BY tree, node)))))
    WHERE feature IS NOT NULL)""",
    f"""nodes AS (SELECT tree, node, depth, n, feature, lows[feature] + share * (highs[feature] - lows[feature]) AS cut
    FROM ({SPLIT} (SELECT tree, node, depth, count(*) AS n, [min(f[1]), min(f[2]), min(f[3])] AS lows, [max(f[1]), max(f[2]), max(f[3])] AS highs
      FROM m GROUP BY ALL)))))""",
    f"""steps AS (SELECT id, f, tree::BIGINT AS tree, 1::BIGINT AS node FROM v, range({novelty.TREES}) t(tree)
    UNION ALL SELECT s.id, s.f, s.tree, 2 * s.node + (s.f[feature] > cut)::INT FROM steps s JOIN nodes USING (tree, node) WHERE feature IS NOT NULL)""",
    f"""paths AS (SELECT id, sum(depth + {NORM.format("n")}) / {novelty.TREES} AS path FROM steps JOIN nodes USING (tree, node) WHERE feature IS NULL GROUP BY id)""",
)


@plans.add("isolation_forest", sql(LOGS, SIMPLE, *FOREST, f"""SELECT id, round(-pow(2::DOUBLE, -path / (SELECT {NORM.format("n")} FROM size)), 9) AS raw FROM paths"""))
def _(spark, d):
    v = simple_vectors(spark, d)
    scored = novelty.with_raw_scores(v, {"isolation_forest": novelty.fit_isolation_forest(v)}, "raw_")
    return scored.select("id", F.round("raw_isolation_forest", 9).alias("raw"))


def scored_by_models(spark, d, with_text=False):
    rows = logs(spark, d, True)
    fitted = features.fit_features(rows, with_text=with_text)
    sizes = novelty.category_sizes(fitted["categories"])
    v = novelty.model_vectors(rows, fitted, sizes=sizes)
    terms = fitted["vocabulary"].count() if with_text else 0
    tables, scored, cuts = novelty.fit_and_score(novelty.training_rows(v, terms))
    return novelty.verdicts(v.join(scored, "id"), list(tables), cuts, feature_names=novelty.vector_names(sizes, terms=terms))


def verdicts(spark, d, with_text):
    return scored_by_models(spark, d, with_text).select(
        "id", "anomaly_score", "is_anomaly", "confidence", "anomaly_type",
        F.array_join("anomaly_reasons", "; ").alias("anomaly_reasons"), "feature_count",
    )


@plans.add("ensemble_verdicts")
def _(spark, d):
    """All three models on dense and one-hot features."""
    return verdicts(spark, d, False)


@plans.add("ensemble_verdicts_with_text")
def _(spark, d):
    """The same with term weights added to the vector."""
    return verdicts(spark, d, True)


@plans.add("pipeline_incidents")
def _(spark, d):
    """Logs, model answers, level scores where no model answered, alerts, suppression, first incidents."""
    answered = scored_by_models(spark, d).filter(F.substring("id", 5, 20).cast("bigint") % 3 != 0)
    answers = answered.select(
        "id", "anomaly_score", "anomaly_reasons", F.lit(None).cast("map<string,double>").alias("feature_scores"), "anomaly_type"
    )
    scored = scoring.score_with_fallback(logs(spark, d, True), answers)
    found = alerts.build_alerts(alerts.alert_candidates(scored))
    first = incidents.initial_incidents(suppress.suppress_duplicates(found))
    return first.select("alert_id", "source_log_id", "service_name", "severity", "anomaly_type", "impact_score", "created_at")


def trained(spark, d):
    """One model per service, trained on its logs."""
    return logs(spark, d).groupBy(F.col("service_name").alias("model_name")).agg(
        F.count("*").alias("training_samples"), F.max("event_ts").alias("last_trained")
    )


TRAINED = "trained AS (SELECT service_name AS model_name, count(*) AS training_samples, max(event_ts) AS last_trained FROM logs GROUP BY 1)"


@plans.add("model_status", sql(LOGS, TRAINED, "SELECT *, CASE WHEN training_samples >= 2500 THEN 'loaded' ELSE 'training' END AS status FROM trained"))
def _(spark, d):
    return novelty.model_status(trained(spark, d), 2500)


@plans.add("model_health", sql(LOGS, TRAINED, """SELECT CASE WHEN bool_and(training_samples >= 2500) THEN 'healthy' ELSE 'degraded' END AS overall_status,
  count(*) AS total_models, count(*) FILTER (training_samples >= 2500) AS loaded_models FROM trained"""))
def _(spark, d):
    return novelty.model_health(novelty.model_status(trained(spark, d), 2500))


@plans.add("model_evaluation", sql("""s AS (SELECT n_chars < 600 AS p, quality = 0 AS y FROM documents JOIN labels USING (doc_id)),
  c AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn, count(*) FILTER (NOT p AND NOT y) AS tn FROM s)""",
  """SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score FROM c"""))
def _(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    judged = docs.join(labels, "doc_id").select(
        (F.col("n_chars") < 600).alias("is_anomaly"), (F.col("quality") == 0).alias("label")
    )
    out = novelty.evaluate(judged)
    return out.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")])


@plans.add("model_store_newest", sql(LOGS, SIMPLE, KERNEL.replace(f"range({novelty.FREQUENCIES}) a(j)", "range(16) a(j)"),
  """SELECT j::INTEGER AS frequency, round(c, 6) AS cosine, round(s, 6) AS sine, (SELECT count(*) FROM v)::VARCHAR AS training_samples FROM sums"""))
def _(spark, d):
    """A model stored twice, the second time from all rows: the newest version and its metadata."""
    folder, v = new_folder(spark, "model-store"), simple_vectors(spark, d)
    for version, rows in ((1, v.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == 0)), (2, v)):
        novelty.save_model(novelty.fit_kernel(rows, 16), folder, "one_class_svm", version, {"training_samples": rows.count()})
    model, metadata = novelty.load_model(spark, folder, "one_class_svm")
    samples = metadata.filter(F.col("key") == "training_samples").select("model", F.col("value").alias("training_samples"))
    shown = model.select("frequency", *[F.round(c, 6).alias(c) for c in ("cosine", "sine")], F.lit("one_class_svm").alias("model"))
    return shown.join(samples, "model").drop("model")


@plans.add("model_refit_status", sql(LOGS, """n AS (SELECT count(*) AS n FROM logs)""", """SELECT m AS model_name, '3' AS version, n AS training_samples,
  CASE WHEN n >= 1000 THEN 'loaded' ELSE 'training' END AS status FROM n, (SELECT unnest(['isolation_forest', 'one_class_svm']) AS m)"""))
def _(spark, d):
    """A refit on all rows writes its version and reports it."""
    folder = new_folder(spark, "refit")
    return novelty.refit(simple_vectors(spark, d), folder, 3, ("isolation_forest", "one_class_svm"))
