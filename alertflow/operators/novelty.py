"""Novelty models: fitted on all rows, stored as tables, applied to whole tables.

The forest (rows of a tree are a parameter of the method) and the kernel model (sums over all rows per random feature)
are tables whose size is fixed by parameters. Scoring loads them, checks their size, broadcasts them and runs as one
Arrow function on the feature column, so the scored rows are not shuffled. The local outlier factor keeps every row; it is
fitted and applied by an exact nearest-neighbour join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertflow.functions.quantile import exact_quantiles
from alertflow.operators import features as fx
from alertflow.operators import scoring
from alertflow.operators.neighbours import knn_lists
from alertflow.session import cut_lineage, stored

# Model parameters.
TREES, TREE_SAMPLE, SEED, CONTAMINATION = 100, 256, 42, 0.1
NU, NEIGHBOURS = 0.1, 20
MIN_SAMPLES, REFIT_HOURS = 1000, 24
ROW_CHUNK = 1000
# Random features of the kernel model; draws are whole numbers below SPAN, moved by STEP from tree to tree.
FREQUENCIES = 512
SPAN, STEP = 1 << 52, 2_783_377_641_436_327


# -- samples ---------------------------------------------------------------


def bounded_sample(df: DataFrame, k: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """The ``k`` rows with the smallest seeded hash: random, without replacement, repeatable.

    A threshold on the hash, set from the row count with a ten-sigma margin, drops
    nearly all rows at the scan, so the top-k never sees more than a little over k.
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    share = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    n = df.agg(F.count("*")).scalar()
    wanted = F.lit(k + 10 * k**0.5 + 100) / F.greatest(n, F.lit(1))
    return df.filter(share <= wanted).orderBy(h, F.col(id_col)).limit(k)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.empty((0, 0))


def _with_terms(dense: np.ndarray, slots: pd.Series, weights: pd.Series, width: int) -> np.ndarray:
    """Dense block followed by the term block, filled from each row's (slot, weight) pairs."""
    out = np.zeros((len(dense), max(width, dense.shape[1])))
    out[:, : dense.shape[1]] = dense
    for i, (at, w) in enumerate(zip(slots, weights)):
        if at is not None and len(at):
            at = np.asarray(at) + dense.shape[1]
            known = at < out.shape[1]
            out[i, at[known]] = np.asarray(w)[known]
    return out


# -- isolation forest -----------------------------------------------------------------

TREE_SCHEMA = "tree int, node int, feature int, cut double, low int, high int, size int, depth int, sample int"


def path_norm(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def node_draws(seed: int, tree: int, path: int) -> tuple[int, float]:
    """A whole number and a share in [0, 1) for a node, which is named by its path: 1, then 2 p and 2 p + 1."""
    h = hashlib.md5(f"{seed}:{tree}:{path}".encode()).hexdigest()
    return int(h[13:26], 16), int(h[:13], 16) / SPAN


def grow_tree(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes (feature, cut, low, high, size, depth); feature -1 marks a leaf. Draws follow from seed, tree and path."""
    nodes: list[list] = []
    work = [(np.arange(len(x)), 0, 1, None, 0)]
    while work:
        rows, depth, path, parent, side = work.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][2 + side] = me
        part = x[rows]
        if depth >= limit or len(rows) < 2:
            continue
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if len(usable) == 0:
            continue
        which, share = node_draws(seed, tree, path)
        f = int(usable[which % len(usable)])
        cut = float(low[f] + share * (high[f] - low[f]))
        left = part[:, f] <= cut
        nodes[me][0], nodes[me][1] = f, cut
        work.append((rows[~left], depth + 1, 2 * path + 1, me, 1))
        work.append((rows[left], depth + 1, 2 * path, me, 0))
    return [tuple(n) for n in nodes]


def tree_samples(vectors: DataFrame, trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = SEED) -> DataFrame:
    """(tree, id, features): ``sample`` rows of the whole table for each tree, without replacement.

    A row has one draw; a tree moves all draws around by its own step and takes the smallest, so its rows come from all
    rows with equal chance. A threshold from the row count (ten sigma) leaves a little over ``sample`` rows a tree.
    """
    draw = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("long")
    n = vectors.agg(F.count("*")).scalar()
    limit = F.lit(float(SPAN)) * F.lit(sample + 10 * sample**0.5 + 100) / F.greatest(n, F.lit(1))
    rows = vectors.select("id", "features", draw.alias("_h")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    moved = (F.col("_h") + F.col("tree").cast("long") * F.lit(STEP)) % F.lit(SPAN)
    likely = rows.withColumn("_h", moved).filter(F.col("_h") <= limit)
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_h", "id"))
    return likely.withColumn("_r", rank).filter(F.col("_r") <= sample).select("tree", "id", "features")


def fit_isolation_forest(vectors: DataFrame, trees: int = TREES, sample: int = TREE_SAMPLE, seed: int = SEED) -> DataFrame:
    """Tree table. Every tree draws ``sample`` rows from the whole table and is grown in its own task."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        limit = int(np.ceil(np.log2(max(len(pdf), 2))))
        nodes = grow_tree(_matrix(pdf["features"]), seed, tree, limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "size", "depth"])
        return out.assign(tree=tree, node=range(len(nodes)), sample=len(pdf))[
            ["tree", "node", "feature", "cut", "low", "high", "size", "depth", "sample"]
        ]

    return tree_samples(vectors, trees, sample, seed).groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


@dataclass
class Forest:
    trees: list[dict[str, np.ndarray]]
    sample: int

    @classmethod
    def load(cls, table: DataFrame, max_nodes: int = 1_000_000) -> "Forest":
        pdf = _bounded(table, max_nodes).sort_values(["tree", "node"])
        trees = [
            {c: g[c].to_numpy() for c in ("feature", "cut", "low", "high", "size", "depth")}
            for _, g in pdf.groupby("tree")
        ]
        return cls(trees, int(pdf["sample"].max()))

    @property
    def width(self) -> int:
        return max(int(t["feature"].max()) for t in self.trees) + 1

    def raw(self, x: np.ndarray) -> np.ndarray:
        return in_chunks(x, self._raw)

    @cached_property
    def steps(self) -> list[tuple[np.ndarray, ...]]:
        """Of each tree: features, cuts, the two children one after the other (a leaf's are itself), levels, path lengths."""
        out = []
        for t in self.trees:
            leaf, me = t["feature"] < 0, np.arange(len(t["feature"]))
            kids = np.column_stack([np.where(leaf, me, t["high"]), np.where(leaf, me, t["low"])]).ravel()
            levels = int(t["depth"].max() - t["depth"].min())
            out.append((np.where(leaf, 0, t["feature"]), t["cut"], kids, levels, t["depth"] + path_norm(t["size"])))
        return out

    def _raw(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        flat, starts = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for feature, cut, kids, levels, path in self.steps:
            at = np.zeros(len(x), dtype=int)
            for _ in range(levels):
                goes_low = flat.take(starts + feature.take(at)) <= cut.take(at)
                at = kids.take(2 * at + goes_low)
            depth += path.take(at)
        return -np.exp2(-depth / len(self.trees) / max(float(path_norm(self.sample)), 1e-12))


# -- kernel mean ----------------------------------------------------------------------

KERNEL_SCHEMA = "frequency int, weights array<double>, cosine double, sine double, gamma double"


def normal_draw(name: str) -> float:
    """A standard normal number from the digest of a name (Box and Muller)."""
    h = hashlib.md5(name.encode()).hexdigest()
    u, v = (int(h[:13], 16) + 1) / SPAN, int(h[13:26], 16) / SPAN
    return float(np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v))


def kernel_error(frequencies: int, rows: int, risk: float = 1e-6) -> float:
    """With probability 1 - ``risk`` no score of ``rows`` is further than this from the exact kernel mean (Hoeffding)."""
    return float(np.sqrt(2.0 * np.log(2.0 * max(rows, 1) / risk) / frequencies))


def fit_kernel(vectors: DataFrame, frequencies: int = FREQUENCIES, seed: int = SEED) -> DataFrame:
    """Mean of the Gaussian kernel over all rows, by random Fourier features (Rahimi and Recht 2007).

    The width is 1 / (dimensions * variance of all entries). For frequencies w drawn from the kernel's spectrum, the mean
    of cos(w (x - y)) over w estimates the kernel, and its mean over all rows y needs only the mean cosine and sine of w y:
    two combinable sums a frequency, whatever the number of rows. ``kernel_error`` bounds the error.

    This is the equal-weight case of a one-class kernel machine: no quadratic program is solved.
    """
    spark = vectors.sparkSession
    entry = vectors.select(F.size("features").alias("d"), F.explode("features").alias("v"))
    found = entry.agg(F.max("d").alias("d"), F.var_pop("v").alias("var")).first()
    if not found["d"]:
        return spark.createDataFrame([], KERNEL_SCHEMA)
    d = found["d"]
    gamma = 1.0 / (d * found["var"]) if found["var"] else 1.0
    weights = np.array([[normal_draw(f"{seed}:{j}:{i}") for i in range(d)] for j in range(frequencies)]) * np.sqrt(2.0 * gamma)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cosine, sine, n = np.zeros(frequencies), np.zeros(frequencies), 0
        for b in batches:
            for low in range(0, len(b), ROW_CHUNK):
                turn = _matrix(b["features"].iloc[low : low + ROW_CHUNK]) @ weights.T
                cosine, sine, n = cosine + np.cos(turn).sum(axis=0), sine + np.sin(turn).sum(axis=0), n + len(turn)
        yield pd.DataFrame({"frequency": range(frequencies), "c": cosine, "s": sine, "n": n})

    parts = vectors.select("features").mapInPandas(sums, "frequency int, c double, s double, n long")
    total = parts.groupBy("frequency").agg((F.sum("c") / F.sum("n")).alias("cosine"), (F.sum("s") / F.sum("n")).alias("sine"))
    table = spark.createDataFrame(pd.DataFrame({"frequency": range(frequencies), "weights": [list(map(float, w)) for w in weights]}), "frequency int, weights array<double>")
    return table.join(total, "frequency").withColumn("gamma", F.lit(gamma))


def in_chunks(x: np.ndarray, fn) -> np.ndarray:
    parts = [fn(x[i : i + ROW_CHUNK]) for i in range(0, len(x), ROW_CHUNK)]
    return np.concatenate(parts) if parts else np.empty(0)


@dataclass
class Kernel:
    weights: np.ndarray
    cosine: np.ndarray
    sine: np.ndarray

    @classmethod
    def load(cls, table: DataFrame, max_rows: int = 10_000) -> "Kernel":
        pdf = _bounded(table, max_rows).sort_values("frequency")
        return cls(_matrix(pdf["weights"]), pdf["cosine"].to_numpy(), pdf["sine"].to_numpy())

    @property
    def width(self) -> int:
        return self.weights.shape[1]

    def raw(self, x: np.ndarray) -> np.ndarray:
        def part(c: np.ndarray) -> np.ndarray:
            turn = c @ self.weights.T
            return (np.cos(turn) @ self.cosine + np.sin(turn) @ self.sine) / len(self.weights)

        return in_chunks(x, part)


# -- local outlier factor -----------------------------------------------------------------


def lof_densities(near: DataFrame, k: int) -> DataFrame:
    """(id, k_distance, density) of every row, from the list of its ``k`` + 1 nearest rows, itself among them or not."""
    others = F.slice(F.filter("near", lambda x: x["other"] != F.col("id")), 1, k)
    mine = near.select("id", others.alias("near")).filter(F.size("near") > 0)
    reach = mine.select("id", F.element_at("near", -1)["d"].alias("k_distance"))
    other = reach.select(F.col("id").alias("other"), F.col("k_distance").alias("other_k"))
    density = mine.select("id", F.inline("near")).join(other, "other").groupBy("id").agg(
        (F.lit(1.0) / (F.avg(F.greatest("d", "other_k")) + F.lit(1e-10))).alias("density")
    )
    return reach.join(density, "id")


def placed(rows: DataFrame) -> DataFrame:
    """(id, features, at, place), written: numbers in the order of the ids. Rows of one id have the place of its first row,
    which is what joins and ties work on; a null id has none."""
    numbers = rows.select("id", "features").repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id())
    first = F.min("at").over(Window.partitionBy("id"))
    return stored(numbers.withColumn("place", F.when(F.col("id").isNotNull(), first)), "lof-rows")


def by_place(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("place").alias("id"), "features")


def lof_model(rows: DataFrame, densities: DataFrame, k: int) -> DataFrame:
    """(id, features, k_distance, density, k) of every placed row."""
    of_place = densities.withColumnRenamed("id", "place")
    return rows.join(of_place, "place").select("id", "features", "k_distance", "density", F.lit(k).alias("k"))


def fit_lof(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Every row with its k-distance and local reachability density, by an exact neighbour join of all rows."""
    rows = placed(vectors)
    keyed = by_place(rows)
    return lof_model(rows, lof_densities(knn_lists(keyed, keyed, k + 1), k), k)


def _lof(near: DataFrame, model: DataFrame, k: int) -> DataFrame:
    there = model.select(F.col("id").alias("other"), "k_distance", "density")
    reach = F.avg(F.greatest("d", "k_distance")) + F.lit(1e-10)
    pairs = near.select("id", F.inline(F.slice("near", 1, k)))
    return pairs.join(there, "other").groupBy("id").agg((-(F.avg("density") * reach)).alias("raw"))


def score_lof(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """(id, raw): minus the neighbours' mean density over the row's own; neighbours are rows of the model."""
    k = model.select("k").first()["k"]
    return _lof(knn_lists(vectors.select("id", "features"), model, k), model, k)


def lof_of_all(vectors: DataFrame, k: int = NEIGHBOURS) -> tuple[DataFrame, DataFrame]:
    """The model of all rows and the scores of the same rows, from one neighbour join."""
    rows = placed(vectors)
    keyed = by_place(rows)
    near = knn_lists(keyed, keyed, k + 1)
    densities = stored(lof_densities(near, k), "lof-densities")
    scores = _lof(near, keyed.select("id").join(densities, "id"), k)
    names = rows.filter(F.col("at") == F.col("place")).select("place", "id")
    raw = names.join(scores.withColumnRenamed("id", "place"), "place").select("id", "raw")
    return lof_model(rows, densities, k), stored(raw, "lof-scores")


def _bounded(table: DataFrame, max_rows: int) -> pd.DataFrame:
    """A model table on the driver, refused when it is larger than a model can be."""
    pdf = table.limit(max_rows + 1).toPandas()
    if not 0 < len(pdf) <= max_rows:
        raise ValueError(f"model table has {len(pdf)} rows, expected 1 to {max_rows}")
    return pdf


# -- scoring -----------------------------------------------------------------------------------

LOADERS = {"isolation_forest": Forest.load, "one_class_svm": Kernel.load}
FITTERS = {"isolation_forest": fit_isolation_forest, "one_class_svm": fit_kernel, "local_outlier_factor": fit_lof}


def raw_scores(spark: SparkSession, tables: Mapping[str, DataFrame], with_terms: bool = False) -> Column:
    """Struct of raw scores, one field per model, from one pass over the feature columns."""
    loaded = spark.sparkContext.broadcast({n: LOADERS[n](t) for n, t in tables.items()})
    names = list(tables)
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    def score(x: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({n: loaded.value[n].raw(x) if len(x) else [] for n in names})

    if with_terms:

        @F.pandas_udf(schema)
        def apply_terms(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            width = max(m.width for m in loaded.value.values())
            for dense, slots, weights in batches:
                yield score(_with_terms(_matrix(dense), slots, weights, width))

        return apply_terms(F.col("features"), F.col("term_slots"), F.col("term_weights"))

    @F.pandas_udf(schema)
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for dense in batches:
            yield score(_matrix(dense))

    return apply(F.col("features"))


def with_raw_scores(
    vectors: DataFrame, tables: Mapping[str, DataFrame], prefix: str = "raw_", known: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Adds ``<prefix><model>``. Small models score in one pass; the local outlier factor, whose model holds every row, by
    a neighbour join on the unique ``id``. ``known`` has (id, raw) of models that are already scored."""
    known = dict(known or {})
    sparse = "term_slots" in vectors.columns
    small = {n: t for n, t in tables.items() if n in LOADERS and n not in known}
    out = vectors
    if small:
        out = out.withColumn("_raw", raw_scores(vectors.sparkSession, small, sparse))
        out = out.select(*vectors.columns, *[F.col(f"_raw.{n}").alias(f"{prefix}{n}") for n in small])
    for n in tables:
        if n in LOADERS and n not in known:
            continue
        if n not in known:
            width = F.size("features") if not sparse else F.lit(tables[n].select(F.size("features").alias("w")).first()["w"])
            known[n] = score_lof(with_term_block(vectors, width - F.size("features")) if sparse else vectors, tables[n])
        out = out.join(known[n].select("id", F.col("raw").alias(f"{prefix}{n}")), "id")
    return out.select(*vectors.columns, *[f"{prefix}{n}" for n in tables])


def fit_thresholds(
    sample: DataFrame, tables: Mapping[str, DataFrame], contamination: float = CONTAMINATION
) -> DataFrame:
    """(model, threshold): the contamination quantile of the raw scores of the training rows."""
    scored = cut_lineage(with_raw_scores(sample.select("id", "features"), tables, "").select(*tables))
    return contamination_threshold(scored, list(tables), contamination)


def contamination_threshold(
    scored: DataFrame, models: Sequence[str], contamination: float = CONTAMINATION
) -> DataFrame:
    """(model, threshold): exact quantile of each model's raw score column."""
    found = exact_quantiles(scored, {m: (m, contamination) for m in models})
    return scored.sparkSession.createDataFrame([(m, found[m]) for m in models], "model string, threshold double")


def flag_models(scored: DataFrame, thresholds: DataFrame, models: Sequence[str]) -> DataFrame:
    """``<model>_flag``: raw score below the model's threshold (one row per model)."""
    pairs = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("model", "threshold")))).scalar()
    return scored.withColumns({f"{m}_flag": F.col(f"raw_{m}") < pairs[m] for m in models})


def category_sizes(categories: DataFrame, limit: int = 10_000) -> dict[str, int]:
    sizes = {r["column"]: r["n"] for r in categories.groupBy("column").agg(F.count("*").alias("n")).collect()}
    wide = {c: n for c, n in sizes.items() if n > limit}
    if wide:
        raise ValueError(f"too many categories for a one-hot vector: {wide}")
    return sizes


def model_vectors(
    logs: DataFrame,
    fitted: Mapping[str, DataFrame],
    columns: Sequence[str] = ("service_name", "level"),
    sizes: Mapping[str, int] | None = None,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """Log rows with ``features``: dense features, one-hot blocks of ``columns`` and, where the fit
    has a vocabulary, its term weights."""
    sizes = sizes or category_sizes(fitted["categories"])
    out = fx.transform_features(logs, fitted)
    dense = F.array(*[F.col(c).cast("double") for c in fx.dense_names()])

    def block(c: str) -> Column:
        slots = F.sequence(F.lit(0), F.lit(sizes[c] - 1))
        return F.transform(slots, lambda i: (i == F.col(f"{c}_encoded")).cast("double"))

    out = out.withColumn("features", F.concat(dense, *[block(c) for c in columns]))
    if "vocabulary" not in fitted:
        return out
    cleaned = logs.select("id", fx.text.clean_text(F.col("message")).alias("cleaned"))
    weights = fx.tfidf(cleaned, fitted["vocabulary"], "id", "cleaned", stop_words)
    # at most one entry per vocabulary term in each row
    packed = weights.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_t"))
    return (
        out.join(packed, "id", "left")
        .withColumns({"term_slots": F.col("_t.idx"), "term_weights": F.col("_t.weight")})
        .drop("_t")
    )


def with_term_block(vectors: DataFrame, terms: Column) -> DataFrame:
    """(id, features) with the term weights as ordinary entries behind the others."""
    pairs = F.map_from_arrays(
        F.coalesce("term_slots", F.array().cast("array<int>")),
        F.coalesce("term_weights", F.array().cast("array<double>")),
    )
    slots = F.filter(F.sequence(F.lit(0), terms), lambda i: i < terms)
    block = F.transform(slots, lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return vectors.withColumn("_m", pairs).select("id", F.concat("features", block).alias("features"))


def training_rows(vectors: DataFrame, terms: int = 0, max_samples: int | None = None) -> DataFrame:
    """(id, features) to fit on, written once so that fitting several models reads it, not the logs: all rows, or the
    ``max_samples`` with the smallest hash.

    ``terms`` is the vocabulary size; term weights become ordinary entries of the vectors.
    """
    cols = ["id", "features", *[c for c in ("term_slots", "term_weights") if c in vectors.columns]]
    rows = vectors.select(*cols) if max_samples is None else bounded_sample(vectors.select(*cols), max_samples)
    if len(cols) > 2 and terms:
        rows = with_term_block(rows, F.lit(terms))
    if max_samples is not None:
        # a limit leaves one partition; later passes over the sample should use every core
        rows = rows.repartition(vectors.sparkSession.sparkContext.defaultParallelism, "id")
    return stored(rows.select("id", "features"), "training-rows")


def fit_models(rows: DataFrame, models: Sequence[str] = scoring.MODELS) -> dict[str, DataFrame]:
    return {m: FITTERS[m](rows) for m in models}


def fit_and_score(
    rows: DataFrame, models: Sequence[str] = scoring.MODELS, contamination: float = CONTAMINATION
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Models of all ``rows`` (a written table), the rows' own raw scores (id and a column a model), and thresholds."""
    tables, known = {}, {}
    for m in models:
        if m == "local_outlier_factor":
            tables[m], known[m] = lof_of_all(rows)
        else:
            tables[m] = FITTERS[m](rows)
    scored = stored(with_raw_scores(rows, tables, "raw_", known).drop("features"), "raw-scores")
    named = scored.select(*[F.col(f"raw_{m}").alias(m) for m in models])
    return tables, scored, contamination_threshold(named, list(models), contamination)


def score_ensemble(
    vectors: DataFrame,
    tables: Mapping[str, DataFrame],
    thresholds: DataFrame,
    threshold: float = scoring.MODEL_THRESHOLD,
    normalise=scoring.normalise,
    feature_names: Sequence[str] | None = None,
) -> DataFrame:
    """Logs with per-model scores and flags, the ensemble verdict, type, reasons and advice."""
    return verdicts(with_raw_scores(vectors, tables), list(tables), thresholds, threshold, normalise, feature_names)


def verdicts(
    scored: DataFrame, names: Sequence[str], thresholds: DataFrame, threshold: float = scoring.MODEL_THRESHOLD,
    normalise=scoring.normalise, feature_names: Sequence[str] | None = None,
) -> DataFrame:
    """The same for log rows that have ``raw_<model>`` already."""
    raw = flag_models(scored, thresholds, names)
    wide = raw.withColumns({m: normalise(F.col(f"raw_{m}")) for m in names})
    return scoring.assemble_results(wide, feature_names or fx.dense_names(), names, threshold)


def vector_names(sizes: Mapping[str, int], columns: Sequence[str] = ("service_name", "level"), terms: int = 0) -> list[str]:
    """Names of all entries of a model vector in order: dense features, one-hot blocks, terms."""
    blocks = [f"{c}_onehot_{i}" for c in columns for i in range(sizes[c])]
    return [*fx.dense_names(), *blocks, *(f"text_tfidf_{i}" for i in range(terms))]


# -- model store, status, evaluation --------------------------------------------------------------


def save_model(table: DataFrame, folder: str, name: str, version: int, metadata: Mapping[str, str] | None = None) -> None:
    """One folder per model and version; a version is never rewritten."""
    table.write.mode("errorifexists").parquet(f"{folder}/{name}/version={int(version)}")
    spark = table.sparkSession
    meta = [(name, int(version), str(k), str(v)) for k, v in (metadata or {}).items()]
    frame = spark.createDataFrame(meta, "model string, model_version int, key string, value string")
    frame.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/{name}_metadata/version={int(version)}")


def load_model(spark: SparkSession, folder: str, name: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Model table and its metadata; the newest version unless one is named."""
    models = spark.read.parquet(f"{folder}/{name}")
    metadata = spark.read.parquet(f"{folder}/{name}_metadata")
    wanted = F.lit(int(version)) if version is not None else models.agg(F.max("version")).scalar()
    pick = lambda df: df.filter(F.col("version") == wanted).drop("version")
    return pick(models), pick(metadata)


def model_status(trained: DataFrame, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Status rows from (model_name, version, last_trained, training_samples)."""
    ready = F.col("training_samples") >= min_samples
    return trained.withColumn("status", F.when(ready, F.lit("loaded")).otherwise(F.lit("training")))


def model_health(status: DataFrame) -> DataFrame:
    good = F.bool_and(F.col("status") == "loaded")
    return status.agg(
        F.when(good, F.lit("healthy")).otherwise(F.lit("degraded")).alias("overall_status"),
        F.count("*").alias("total_models"),
        F.count_if(F.col("status") == "loaded").alias("loaded_models"),
    )


def evaluate(scored: DataFrame, prediction: str = "is_anomaly", label: str = "label") -> DataFrame:
    """Confusion counts and the usual ratios from boolean columns."""
    p, y = F.col(prediction), F.col(label)
    counts = scored.agg(
        F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"),
        F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + fp + fn + tn),
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f1_score": ratio(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
        }
    )


def refit(
    vectors: DataFrame, folder: str, version: int, models: Sequence[str] = scoring.MODELS,
    min_samples: int = MIN_SAMPLES, max_samples: int | None = None,
) -> DataFrame | None:
    """Fit every model on all rows (or on ``max_samples`` of them) and store it as a new version.

    Run it from a scheduler every ``REFIT_HOURS``. Returns the status rows, or
    None without writing when there are too few rows to train on.
    """
    spark = vectors.sparkSession
    sample = training_rows(vectors, max_samples=max_samples)
    n = sample.count()
    if n < min_samples:
        return None
    for m in models:
        save_model(FITTERS[m](sample), folder, m, version, {"training_samples": n, "contamination": CONTAMINATION})
    rows = [(m, str(version), n) for m in models]
    trained = spark.createDataFrame(rows, "model_name string, version string, training_samples bigint")
    return model_status(trained, min_samples)
