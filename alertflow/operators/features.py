"""Features of log rows: fitted once into small tables, applied as column expressions.

``fit_features`` returns tables, ``transform_features`` adds columns. One-row
statistics enter the plan as scalar sub-queries, so applying them needs no join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertflow.functions import rules, text
from alertflow.functions.quantile import exact_quantiles
from alertflow.session import cut_lineage, once, stored

CATEGORICAL = ("service_name", "hostname", "level", "logger")
NUMERIC = ("duration_ms", "line_number")
PATTERN_NAMES = tuple(text.PATTERNS)
WINDOWS_MINUTES = (1, 5, 15, 60)
# Vocabulary limits.
MIN_DF, MAX_DF, MAX_N = 2, 0.95, 2
EPSILON = 1e-8
#: Terms of a vocabulary from which on it is looked up by hash in shuffled rows.
LOOKED_UP = 100_000


# -- plain column features -----------------------------------------------------


def basic_features() -> dict[str, Column]:
    return {
        "log_level_severity": rules.level_rank(F.col("level")),
        "message_length": F.length(F.coalesce("message", F.lit(""))),
        "has_exception": F.col("exception").isNotNull().cast("int"),
        "has_stack_trace": F.col("stack_trace").isNotNull().cast("int"),
        "http_status_category": rules.http_class(F.col("http_status")),
    }


def temporal_features() -> dict[str, Column]:
    day = F.weekday("event_ts")
    return {
        "hour_of_day": F.hour("event_ts"),
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
    }


def pattern_features() -> dict[str, Column]:
    counts = {f"pattern_{n}_count": text.pattern_count(F.col("message"), n) for n in PATTERN_NAMES}
    return {**counts, "message_entropy": text.entropy(F.col("message"))}


def epoch_seconds(ts: str = "event_ts") -> Column:
    return F.floor(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts})") / 1_000_000)


# -- fitted statistics -----------------------------------------------------------


def fit_statistics(logs: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """One row: time range, and mean, population deviation and median of each number."""
    t = epoch_seconds()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric}
    return logs.agg(
        F.min(t).alias("t_min"),
        F.max(t).alias("t_max"),
        F.count("*").alias("rows"),
        *[F.avg(v).alias(f"{c}_mean") for c, v in filled.items()],
        *[F.stddev_pop(v).alias(f"{c}_std") for c, v in filled.items()],
        *[F.percentile_approx(F.col(c).cast("double"), 0.5, 10_000).alias(f"{c}_approx_median") for c in numeric],
    )


def fit_medians(logs: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    """One row of exact medians."""
    found = exact_quantiles(logs, {c: (c, 0.5) for c in numeric})
    return logs.sparkSession.range(1).select(*[F.lit(found[c]).cast("double").alias(f"{c}_median") for c in numeric])


def one_row(stats: DataFrame) -> Column:
    """The single row of ``stats`` as a struct value."""
    return stats.select(F.struct(*stats.columns)).scalar()


def time_position(stats: DataFrame) -> Column:
    s = one_row(stats)
    span = (s["t_max"] - s["t_min"]).cast("double") + F.lit(EPSILON)
    return (epoch_seconds() - s["t_min"]).cast("double") / span


def scaled(stats: DataFrame, numeric: Sequence[str] = NUMERIC) -> dict[str, Column]:
    s = one_row(stats)
    out = {}
    for c in numeric:
        std = s[f"{c}_std"]
        value = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out[f"{c}_scaled"] = (value - s[f"{c}_mean"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return out


def impute_median(logs: DataFrame, medians: DataFrame, numeric: Sequence[str] = NUMERIC) -> DataFrame:
    s = one_row(medians)
    return logs.withColumns({c: F.coalesce(F.col(c).cast("double"), s[f"{c}_median"]) for c in numeric})


# -- categories --------------------------------------------------------------------


def fit_categories(logs: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """(column, value, idx): distinct values numbered alphabetically from 0 within a column."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")) for c in columns]
    )
    values = logs.select(F.explode(pairs).alias("_p")).select("_p.*").distinct()
    w = Window.partitionBy("column").orderBy("value")
    return values.withColumn("idx", F.row_number().over(w) - 1)


def encode_labels(logs: DataFrame, categories: DataFrame, columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """``<column>_encoded``: the fitted number, -1 for a value not seen in fitting.

    Category tables may grow with the data (host names), so the joins carry no
    broadcast hint; the planner decides by measured size.
    """
    out = logs
    for c in columns:
        known = categories.filter(F.col("column") == c).select(
            F.col("value").alias(f"_v_{c}"), F.col("idx").alias(f"{c}_encoded")
        )
        out = out.join(known, F.coalesce(F.col(c), F.lit("unknown")) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
        out = out.withColumn(f"{c}_encoded", F.coalesce(f"{c}_encoded", F.lit(-1)))
    return out


def one_hot(encoded: DataFrame, id_col: str = "id", columns: Sequence[str] = CATEGORICAL) -> DataFrame:
    """Sparse one-hot rows (id, feature, value); an unseen value has no row, that is all zeros."""
    items = rules.present(
        *[
            F.when(F.col(f"{c}_encoded") >= 0, F.concat(F.lit(f"{c}_onehot_"), F.col(f"{c}_encoded").cast("string")))
            for c in columns
        ]
    )
    return encoded.select(id_col, F.explode(items).alias("feature")).withColumn("value", F.lit(1.0))


# -- text ------------------------------------------------------------------------------


def with_terms(docs: DataFrame, text_col: str, stop_words: Sequence[str] = (), max_n: int = MAX_N) -> DataFrame:
    """``_terms``: all n-grams of a text. Tokens and terms are each computed once per row."""
    words = once(docs, "_words", text.tokens(F.col(text_col), stop_words))
    grams = F.concat(*[text.ngrams(F.col("_words"), n) for n in range(1, max_n + 1)])
    return once(words, "_terms", grams).drop("_words")


def counted_terms(
    docs: DataFrame, text_col: str, stop_words: Sequence[str] = (), max_n: int = MAX_N
) -> DataFrame:
    """A row for each distinct term of each row of ``docs``: the other columns, ``term`` and its count ``tf``.

    Terms are counted where the text is. Where one comes twice they are ordered inside the row, and each run of equal ones
    is a term; else they stay in the order of the text.
    """
    kept = [c for c in docs.columns if c != text_col]
    found, ordered = F.col("_terms"), F.col("_ordered")
    rows = with_terms(docs, text_col, stop_words, max_n).select(*kept, "_terms").filter(F.size(found) > 0)
    rows = once(rows, "_ordered", F.when(F.size(F.array_distinct(found)) < F.size(found), F.sort_array(found)))
    first = F.filter(
        F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
    )
    rows = once(rows, "_first", F.when(ordered.isNotNull(), first))
    runs = F.transform(
        "_first",
        lambda p, j: F.struct(
            F.get(ordered, p).alias("term"),
            (F.coalesce(F.get(F.col("_first"), j + 1), F.size(found)) - p).alias("tf"),
        ),
    )
    single = F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf")))
    return rows.select(*kept, F.inline(F.coalesce(runs, single)))


def numbered(rows: DataFrame, text_col: str, name: str) -> DataFrame:
    """Number rows from 0 in the order of a text, without bringing them into one task.

    Rows are counted by the first two letters; running totals of these counts, which are few, give each group its start.
    """
    group = F.coalesce(F.substring(text_col, 1, 2), F.lit(""))
    sizes = rows.groupBy(group.alias("_g")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_g", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(text_col)) - 1
    placed = rows.withColumn("_g", group).withColumn("_k", place).join(starts, "_g")
    return placed.withColumn(name, (F.col("_start") + F.col("_k")).cast("int")).drop("_g", "_k", "_start")


def fit_vocabulary(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    stop_words: Sequence[str] = (),
    max_n: int = MAX_N,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_terms: int | None = None,
) -> DataFrame:
    """(term, idx, df, idf) of every term within the frequency bounds, or of the ``max_terms`` most frequent ones.

    Document and term frequency come from one shuffle by term: each row sends its distinct terms, with their counts where
    these are ranked, and they are summed before the shuffle, so a frequent term is one partial row per task. The table is
    written, so that the files of its shuffles are gone before it is used.
    """
    source = docs.select(text_col)
    if max_terms is None:
        found = with_terms(source, text_col, stop_words, max_n).select(F.explode(F.array_distinct("_terms")).alias("term"))
    else:
        found = counted_terms(source, text_col, stop_words, max_n)
    counts = [F.count("*").alias("df"), *([F.sum("tf").alias("tf")] if max_terms is not None else [])]
    by_term = found.groupBy("term").agg(*counts)
    n = docs.agg(F.count("*")).scalar()
    kept = by_term.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n))
    top = kept if max_terms is None else kept.orderBy(F.desc("tf"), F.asc("term")).limit(max_terms)
    idf = F.log((n + 1).cast("double") / (F.col("df") + 1)) + F.lit(1.0)
    fitted = numbered(stored(top.select("term", "df", idf.alias("idf")), "terms"), "term", "idx")
    return stored(fitted.select("term", "idx", "df", "idf"), "vocabulary")


def tfidf(
    docs: DataFrame,
    vocabulary: DataFrame,
    id_col: str,
    text_col: str,
    stop_words: Sequence[str] = (),
    max_n: int = MAX_N,
) -> DataFrame:
    """(id, term, idx, weight): L2-normalised term weights.

    The planner broadcasts the vocabulary while it is small; a larger one is dealt by term and looked up by hash, so the
    rows are not ordered by term. Rows are then dealt by id once, without the terms unless these are asked for. Rows of
    one id are one text; they are put together only where an id comes twice.
    """
    found = counted_terms(docs.select(id_col, text_col), text_col, stop_words, max_n)
    terms = vocabulary.select("term", "idx", "idf")
    raw = found.join(terms.hint("shuffle_hash") if vocabulary.count() > LOOKED_UP else terms, "term")
    if not docs.groupBy(id_col).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).isEmpty():
        raw = raw.repartition(id_col).groupBy(id_col, "term", "idx", "idf").agg(F.sum("tf").alias("tf"))
    raw = raw.select(id_col, "term", "idx", (F.col("tf") * F.col("idf")).alias("_w"))
    norm = Window.partitionBy(id_col)
    return raw.withColumn("weight", F.col("_w") / F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(norm))).select(
        id_col, "term", "idx", "weight"
    )


# -- rolling windows and templates ------------------------------------------------------------


def rolling_features(
    logs: DataFrame,
    value: str = "duration_ms",
    minutes: Sequence[int] = WINDOWS_MINUTES,
    key: str = "service_name",
    bucket_s: int = 7_200,
) -> DataFrame:
    """Count, mean, deviation and maximum of ``value`` over the last minutes of each service.

    Rows are windowed inside time buckets so that a busy service spreads over many
    tasks. A row near the end of its bucket is also sent to the next one as
    context, which keeps every frame complete. All frames start at the bucket's
    beginning, so they are running values: the work grows with the rows, not with
    the rows in a window.
    """
    reach = max(minutes) * 60
    if reach > bucket_s:
        raise ValueError("bucket_s must cover the longest window")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', event_ts)")
    width = bucket_s * 1_000_000
    placed = logs.withColumns({"_us": at, "_own": F.floor(at / width)})
    near_end = (F.col("_own") + 1) * width - F.col("_us") <= reach * 1_000_000
    context = F.when(near_end, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))
    spread = placed.withColumn("_bucket", F.explode(context))
    # sums are taken around the bucket's mean, so that differences of running sums keep their digits
    whole = Window.partitionBy(key, "_bucket")
    spread = spread.withColumn("_v", F.col(value).cast("double"))
    spread = spread.withColumn("_c", F.coalesce(F.avg("_v").over(whole), F.lit(0.0))).withColumn("_d", F.col("_v") - F.col("_c"))
    terms = {"rows": F.count("*"), "n": F.count("_d"), "s": F.sum("_d"), "q": F.sum(F.col("_d") * F.col("_d"))}
    out, order = spread, Window.partitionBy(key, "_bucket").orderBy("_us")
    for m in minutes:
        upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        past = order.rangeBetween(Window.unboundedPreceding, -m * 60_000_000 - 1)
        got = {n: F.coalesce(f.over(upto), F.lit(0)) - F.coalesce(f.over(past), F.lit(0)) for n, f in terms.items()}
        out = out.withColumns({f"_{n}_{m}": c for n, c in got.items()} | {f"_noise_{m}": terms["q"].over(upto) * F.lit(1e-13)})
    for m in minutes:
        n, s = F.col(f"_n_{m}"), F.col(f"_s_{m}")
        # a spread below the rounding of the running sums is none
        left = F.col(f"_q_{m}") - s * s / n
        spare = F.when(left > F.col(f"_noise_{m}"), left).otherwise(F.lit(0.0))
        out = out.withColumns(
            {
                f"count_{m}m": F.col(f"_rows_{m}"),
                f"mean_{m}m": F.when(n > 0, F.col("_c") + s / n),
                f"std_{m}m": F.when(n > 1, F.sqrt(spare / (n - 1))),
            }
        ).drop(*[f"_{x}_{m}" for x in (*terms, "noise")])
    for m in minutes:
        out = _window_max(out, key, m)
    names = [f"{x}_{m}m" for m in minutes for x in ("count", "mean", "std", "max")]
    return out.filter(F.col("_bucket") == F.col("_own")).select(*logs.columns, *names)


def _window_max(rows: DataFrame, key: str, minutes: int) -> DataFrame:
    """Largest ``_v`` of the last minutes from two running maxima, whatever the number of rows in the window.

    Time is cut into blocks as long as the window, so a window is the start of its own block and the end of the one
    before. A row is sent to its own block and, as context, to the next; there, rows are ordered by their place in the
    block, forwards for the one part and backwards for the other.
    """
    width = minutes * 60_000_000
    block = F.floor(F.col("_us") / width)
    both = rows.withColumn("_block", F.explode(F.array(block, block + 1)))
    both = both.withColumns({"_now": F.col("_block") == block, "_at": F.col("_us") - block * width})
    group = Window.partitionBy(key, "_bucket", "_block")
    forwards = group.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    backwards = group.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.max(F.when(F.col("_now"), F.col("_v"))).over(forwards)
    before = F.max(F.when(~F.col("_now"), F.col("_v"))).over(backwards)
    return both.withColumn(f"max_{minutes}m", F.greatest(own, before)).filter("_now").drop("_block", "_now", "_at")


def template_counts(logs: DataFrame) -> DataFrame:
    """Masked message templates per service with their size and life span."""
    return logs.groupBy("service_name", text.clean_text(F.col("message")).alias("template")).agg(
        F.count("*").alias("logs"), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen")
    )


def top_templates(logs: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent templates of each service; ranked after aggregation."""
    w = Window.partitionBy("service_name").orderBy(F.desc("logs"), F.asc("template"))
    return template_counts(logs).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def seen_before(logs: DataFrame) -> DataFrame:
    """Flags logs whose template its service produced earlier."""
    first = template_counts(logs).select("service_name", "template", "first_seen", "logs")
    marked = logs.withColumn("template", text.clean_text(F.col("message")))
    joined = marked.join(first.withColumnRenamed("logs", "template_logs"), ["service_name", "template"])
    return joined.withColumn("similar_seen_before", F.col("event_ts") > F.col("first_seen")).drop("first_seen")


# -- fit and transform ---------------------------------------------------------------------------


def fit_features(
    logs: DataFrame, stop_words: Sequence[str] = (), max_terms: int | None = None, with_text: bool = True
) -> dict[str, DataFrame]:
    """All fitted tables: statistics, categories and (optionally) the vocabulary.

    They are written to the checkpoint folder, so applying them never scans the training rows again.
    """
    tables = {"statistics": fit_statistics(logs), "categories": fit_categories(logs)}
    if with_text:
        cleaned = logs.select("id", text.clean_text(F.col("message")).alias("cleaned"))
        tables["vocabulary"] = fit_vocabulary(cleaned, "id", "cleaned", stop_words, max_terms=max_terms)
    return {name: cut_lineage(t) for name, t in tables.items()}


def dense_names() -> list[str]:
    """Dense feature columns in vector order."""
    return [
        "log_level_severity", "message_length", "has_exception", "has_stack_trace", "http_status_category",
        "hour_of_day", "day_of_week", "is_weekend", "time_since_epoch_norm",
        *[f"{c}_scaled" for c in NUMERIC],
        *[f"pattern_{n}_count" for n in PATTERN_NAMES], "message_entropy",
    ]


def transform_features(logs: DataFrame, fitted: Mapping[str, DataFrame], norm: str = "fit") -> DataFrame:
    """Log rows with every dense feature and the category numbers.

    ``norm='fit'`` places times in the fitted range, so results do not depend on
    how rows are batched; ``norm='batch'`` uses the range of ``logs`` itself.
    """
    stats = fitted["statistics"]
    position = time_position(stats if norm == "fit" else fit_statistics(logs))
    out = logs.withColumns(
        {
            **basic_features(),
            **temporal_features(),
            "time_since_epoch_norm": position,
            **scaled(stats),
            **pattern_features(),
        }
    )
    return encode_labels(out, fitted["categories"])


def feature_vector(transformed: DataFrame, id_col: str = "id", columns: Sequence[str] | None = None) -> DataFrame:
    """(id, features array<double>) of the dense columns."""
    names = list(columns) if columns is not None else dense_names()
    return transformed.select(id_col, F.array(*[F.col(c).cast("double") for c in names]).alias("features"))


def equal_importance(names: DataFrame) -> DataFrame:
    """Weight 1/n for each of the n feature names."""
    n = names.agg(F.count("*")).scalar()
    return names.withColumn("importance_score", F.lit(1.0) / n)
