"""Hot keys against brute force, and the novelty models against plain numpy."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from alertflow.operators import features, neighbours, novelty, scoring
from alertflow.operators.ordered import previous_values
from alertflow.plans import tables
from alertflow.sources import intake

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("bucket", [60, 3600, 10_000_000])
def test_previous_values_with_a_hot_key(spark, bucket):
    rnd = random.Random(7)
    rows = [
        ("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", T0 + dt.timedelta(seconds=rnd.randrange(20_000)), i,
         rnd.choice("ABC"), rnd.choice(["x", "y", None, None]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, n bigint, s string, a string")
    got = {r.n: (r.is_first, r.previous_s, r.previous_a) for r in previous_values(df, "k", ["ts", "n"], ["s"], ["a"], bucket).collect()}
    want, last, known = {}, {}, {}
    for k, ts, n, s, a in sorted(rows, key=lambda r: (r[1], r[2])):
        want[n] = (k not in last, last.get(k), known.get(k))
        last[k] = s
        known[k] = a if a is not None else known.get(k)
    assert got == want


def test_rolling_features_across_buckets(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.7 else "b", T0 + dt.timedelta(seconds=rnd.randrange(40_000)), i, float(rnd.randrange(100))) for i in range(500)]
    df = spark.createDataFrame(rows, "service_name string, event_ts timestamp_ntz, id bigint, duration_ms double")
    got = {r.id: r for r in features.rolling_features(df, bucket_s=3600).collect()}
    assert len(got) == len(rows)
    for s, ts, i, v in rows:
        for m in (1, 5, 15, 60):
            near = [x for (q, t, _, x) in rows if q == s and ts - dt.timedelta(minutes=m) <= t <= ts]
            assert got[i][f"count_{m}m"] == len(near)
            assert got[i][f"mean_{m}m"] == pytest.approx(np.mean(near))
            assert got[i][f"max_{m}m"] == max(near)
            if len(near) > 1:
                assert got[i][f"std_{m}m"] == pytest.approx(np.std(near, ddof=1))


def test_rolling_features_of_a_dense_hour(spark):
    """A sliding frame that is summed anew for each row would take minutes here."""
    n = 200_000
    df = spark.range(n).select(
        F.lit("hot").alias("service_name"), F.col("id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 0.018)").alias("event_ts"),
        (F.col("id") % 1000).cast("double").alias("duration_ms"),
    )
    last = features.rolling_features(df).filter(F.col("id") == n - 1).first()
    k = 60 * 1000 // 18 + 1
    near = [float(i % 1000) for i in range(n - k, n)]
    assert last["count_1m"] == k and last["max_1m"] == 999.0
    assert last["mean_1m"] == pytest.approx(np.mean(near)) and last["std_1m"] == pytest.approx(np.std(near, ddof=1))
    assert last["count_60m"] == n


def test_service_order_spreads_a_hot_service(spark):
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "b").otherwise("hot").alias("service_name"),
        (F.lit(T0).cast("timestamp_ntz") + F.expr("make_dt_interval(0,0,0,cast(id as int))")).alias("event_ts"),
    )
    parts = intake.partition_by_service(df, 8).withColumn("p", F.spark_partition_id()).groupBy("p", "service_name").count().collect()
    assert max(r["count"] for r in parts) < 1500


def vectors(spark, n=400, d=3, seed=1):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(size=(n - 4, d)), rng.normal(size=(2, d)) + 9, np.zeros((2, d))])
    pdf = pd.DataFrame({"id": [f"r{i:04d}" for i in range(n)], "features": [list(map(float, r)) for r in x]})
    return spark.createDataFrame(pdf, "id string, features array<double>"), x


def scores(df, tables_, name):
    rows = novelty.with_raw_scores(df, {name: tables_}).orderBy("id").collect()
    return np.array([r[f"raw_{name}"] for r in rows])


def test_kernel_mean_is_within_its_bound(spark):
    df, x = vectors(spark)
    model = novelty.fit_kernel(df)
    got = scores(df, model, "one_class_svm")
    gamma = 1 / (x.shape[1] * x.var())
    assert model.first()["gamma"] == pytest.approx(gamma)
    want = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1)).mean(1)
    off = np.abs(got - want).max()
    assert off < novelty.kernel_error(512, len(x)) < 0.3 and off < 0.12
    fine = scores(df, novelty.fit_kernel(df, frequencies=8000), "one_class_svm")
    assert np.abs(fine - want).max() < min(off, 0.03)
    assert {396, 397} <= set(np.argsort(got)[:20])


def brute_near(x, ids, y, names, k):
    out = {}
    for i, a in zip(ids, x, strict=True):
        d = np.sqrt(((a - y) ** 2).sum(1))
        best = sorted(range(len(y)), key=lambda j: (d[j], names[j]))[:k]
        out[i] = [(names[j], d[j]) for j in best]
    return out


@pytest.mark.parametrize("cell_rows,block", [(10_000, 5000), (40, 16), (7, 500)])
def test_neighbour_join_equals_brute_force(spark, cell_rows, block):
    """A cell that holds most rows, equal rows, lone rows, and queries from elsewhere."""
    rng = np.random.default_rng(5)
    y = np.vstack([rng.normal(0, 0.01, (300, 4)), rng.normal(0, 3, (150, 4)), np.ones((60, 4)), [[50.0] * 4]])
    x = np.vstack([y[::7], rng.normal(0, 4, (60, 4)), [[-80.0] * 4]])
    names, ids = [f"r{i:04d}" for i in range(len(y))], [f"q{i:04d}" for i in range(len(x))]
    table = lambda n, v: spark.createDataFrame(
        pd.DataFrame({"id": n, "features": [list(map(float, r)) for r in v]}), "id string, features array<double>").repartition(3)
    refs, queries = table(names, y), table(ids, x)
    for k in (1, 9):
        for q, qx, qn in ((queries, x, ids), (refs, y, names)):
            found = neighbours.knn_join(q, refs, k, cell_rows=cell_rows, block=block).collect()
            want = brute_near(qx, qn, y, names, k)
            got = {}
            for r in sorted(found, key=lambda r: (r.id, r["rank"])):
                got.setdefault(r.id, []).append((r.other, r.d))
            assert got.keys() == want.keys()
            for i in want:
                assert [o for o, _ in got[i]] == [o for o, _ in want[i]]
                np.testing.assert_allclose([d for _, d in got[i]], [d for _, d in want[i]], rtol=1e-12)
    few = neighbours.knn_join(queries, refs.limit(3), 9)
    assert few.count() == 3 * len(x)
    assert neighbours.knn_join(queries, refs.limit(0), 9).count() == 0


def test_neighbour_blocks_are_bounded(spark):
    """All rows in one cell: no task gets more than about a block of either side."""
    seen = []
    rng = np.random.default_rng(6)
    y = rng.normal(0, 1, (3000, 2))
    refs = spark.createDataFrame(pd.DataFrame({"id": range(len(y)), "features": [list(map(float, r)) for r in y]}), "id bigint, features array<double>")
    pivots = neighbours._pivots(refs, 1, 42)
    assigned = neighbours._assigned(refs, pivots)
    cells = neighbours.Cells(pivots, np.array([3000]), np.array([9.0]), 200)
    every = lambda b: np.ones((b.num_rows, 1), bool)

    def sizes(left, right):
        import pyarrow as pa

        return pa.table({"l": pa.array([left.num_rows], pa.int64()), "r": pa.array([right.num_rows], pa.int64())})

    kind = "id bigint, features array<double>"
    met = neighbours._meet(refs, assigned, cells, np.array([15]), every, True, sizes, "l long, r long", kind, kind).collect()
    seen = [(r.l, r.r) for r in met]
    assert len(seen) == 15 * 15 and max(max(s) for s in seen) < 300 and sum(a * b for a, b in seen) == 3000 * 3000


@pytest.mark.parametrize("task_rows,block", [(40, 16), (150, 2048)])
def test_neighbours_in_other_cells(spark, task_rows, block):
    """Many cells, one of them cut into blocks, single precision at odd scales, rows with gaps, and ids that come twice."""
    rng = np.random.default_rng(8)
    y = np.vstack([rng.normal(0, 1, (400, 3)), rng.normal(0, 1e-9, (80, 3)) + 1e6, np.zeros((300, 3)), rng.normal(0, 1, (60, 3)) * 1e18])
    names = [f"r{i:04d}" for i in range(len(y))]
    rows = [(n, list(map(float, v))) for n, v in zip(names, y, strict=True)]
    kind = "id string, features array<double>"
    refs = spark.createDataFrame([*rows, ("gap", [1.0, None, 2.0]), ("none", None)], kind).repartition(3)
    found = neighbours.knn_join(refs, refs, 6, block=block, task_rows=task_rows).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.id, r["rank"])):
        got.setdefault(r.id, []).append((r.other, r.d))
    want = brute_near(y, names, y, names, 6)
    assert got.keys() == want.keys()
    for i in want:
        assert [o for o, _ in got[i]] == [o for o, _ in want[i]]
        np.testing.assert_allclose([d for _, d in got[i]], [d for _, d in want[i]], rtol=1e-12)
    twice = spark.createDataFrame([*rows[:50], (names[0], rows[300][1])], kind)
    found = neighbours.knn_join(twice, refs.limit(500).filter("features is not null"), 6, block=block, task_rows=task_rows)
    assert found.filter(F.col("id") == names[0]).count() == 6 and found.count() == 300


def test_evenly_spread_rows_are_not_copied_to_every_small_cell(spark, monkeypatch):
    """Where distances exclude nothing, the copies of a row are bounded by what a task holds, not by small cells."""
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (1200, 24))
    rows = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "features": [list(map(float, r)) for r in x]}), "id bigint, features array<double>")
    routed, copies = neighbours._routed, []
    monkeypatch.setattr(neighbours, "_routed", lambda *a: copies.append(routed(*a)) or copies[-1])
    assert neighbours.knn_join(rows, rows, 3, cell_rows=10, block=32).count() == 3 * len(x)
    assert sum(c.count() for c in copies) < 30 * len(x)


def test_lof_of_evenly_spread_rows_copies_a_row_a_few_times(spark, monkeypatch):
    """Rows of several cells' size where nothing is excluded: a bounded number of copies, and all rows are scored."""
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (2600, 16))
    rows = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "features": [list(map(float, r)) for r in x]}), "id bigint, features array<double>")
    routed, copies = neighbours._routed, []
    monkeypatch.setattr(neighbours, "_routed", lambda *a: copies.append(routed(*a)) or copies[-1])
    _, scored = novelty.lof_of_all(rows)
    assert scored.filter("raw < 0").count() == len(x)
    assert sum(c.count() for c in copies) <= 5 * len(x)


def test_search_meets_few_rows_of_other_groups(monkeypatch):
    """Rows that lie in groups, some of them equal, meet a small part of all pairs and find what all pairs find."""
    rng = np.random.default_rng(10)
    y = np.hstack([rng.integers(0, 12, (6000, 1)) * 4.0, rng.integers(0, 7, (6000, 1)) * 4.0, rng.normal(0, 0.3, (6000, 3))])
    y[:500] = y[0]
    met, hits = [], neighbours.Search._hits
    count = lambda left, right, rows, columns, *a: met.append(len(rows) * right[:, columns].shape[1]) or hits(left, right, rows, columns, *a)
    monkeypatch.setattr(neighbours.Search, "_hits", staticmethod(count))
    q, r, d = neighbours.Search(y, 256, 21).nearest(y, 21, np.full(len(y), np.inf))
    assert sum(met) < 0.25 * len(y) ** 2 and (np.bincount(q) == 21).all()
    for i in (0, 499, *range(500, 6000, 97)):
        far = np.sqrt(((y[i] - y) ** 2).sum(1))
        want = np.lexsort((np.arange(len(y)), far))[:21]
        assert r[q == i].tolist() == want.tolist() and d[q == i].tolist() == far[want].tolist()


def test_lof_joins_numbers_and_keeps_rows_of_one_id_together(spark):
    """Rows have places in the order of their ids: one for all rows of an id, none for a null id."""
    rows = [("b", [1.0]), ("a", [2.0]), (None, [3.0]), ("b", [4.0]), ("c", [5.0])]
    got = novelty.placed(spark.createDataFrame(rows, "id string, features array<double>").repartition(3)).collect()
    place = {r.id: r.place for r in got}
    assert place[None] is None and place["a"] < place["b"] < place["c"]
    assert len({r.place for r in got if r.id == "b"}) == 1 and len({r["at"] for r in got}) == 5


def test_forest_scores_follow_each_tree(spark):
    df, x = vectors(spark)
    forest = novelty.Forest.load(novelty.fit_isolation_forest(df, trees=7))
    x = np.vstack([x, np.full((1, x.shape[1]), np.nan)])

    def length(t, row, at=0):
        while t["feature"][at] >= 0:
            at = t["low"][at] if row[t["feature"][at]] <= t["cut"][at] else t["high"][at]
        return t["depth"][at] + float(novelty.path_norm(t["size"][at]))

    mean = np.array([np.mean([length(t, row) for t in forest.trees]) for row in x])
    np.testing.assert_allclose(forest.raw(x), -np.exp2(-mean / float(novelty.path_norm(forest.sample))), rtol=1e-12)


def test_lof_equals_numpy(spark):
    df, x = vectors(spark)
    k = 20
    got = scores(df, novelty.fit_lof(df, k=k), "local_outlier_factor")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    inner = d.copy()
    np.fill_diagonal(inner, np.inf)
    near = np.argsort(inner, axis=1, kind="stable")[:, :k]
    kd = np.take_along_axis(inner, near, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(inner, near, 1), kd[near]).mean(1) + 1e-10)
    seen = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = 1 / (np.maximum(np.take_along_axis(d, seen, 1), kd[seen]).mean(1) + 1e-10)
    np.testing.assert_allclose(got, -(lrd[seen].mean(1) / own), rtol=1e-9)


def test_isolation_forest_finds_outliers_and_repeats(spark):
    df, _ = vectors(spark)
    model = novelty.fit_isolation_forest(df)
    nodes = model.toPandas()
    assert nodes["tree"].nunique() == 100 and (nodes.groupby("tree")["sample"].first() == 256).all()
    assert nodes["depth"].max() <= 8
    leaves = nodes[nodes.feature < 0].groupby("tree")["size"].sum()
    assert (leaves == 256).all()
    got = scores(df, model, "isolation_forest")
    assert ((-1 < got) & (got < 0)).all()
    assert set(np.argsort(got)[:2]) == {396, 397}
    again = scores(df.repartition(7), novelty.fit_isolation_forest(df.repartition(5)), "isolation_forest")
    np.testing.assert_allclose(got, again)


def test_bounded_sample_is_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    import hashlib

    want = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), str(i)) for i in range(5000))[:300]
    got = {r.id for r in novelty.bounded_sample(df.repartition(9), 300).collect()}
    assert got == {i for _, i in want}


def test_threshold_flags_a_tenth(spark):
    df, _ = vectors(spark)
    tabs = {"one_class_svm": novelty.fit_kernel(df)}
    flagged = novelty.flag_models(novelty.with_raw_scores(df, tabs), novelty.fit_thresholds(df, tabs), list(tabs))
    assert flagged.filter("one_class_svm_flag").count() == 40


def test_store_versions_and_refit(spark, tmp_path):
    df, x = vectors(spark, 60)
    folder = str(tmp_path)
    assert novelty.refit(df, folder, 1) is None
    status = novelty.refit(df, folder, 1, min_samples=50)
    assert novelty.model_health(status).first().overall_status == "healthy"
    novelty.refit(df.limit(55), folder, 2, min_samples=50)
    for version, n in ((None, "55"), (1, "60")):
        table, meta = novelty.load_model(spark, folder, "one_class_svm", version)
        assert {r.key: r.value for r in meta.collect()}["training_samples"] == n
    got = scores(df, novelty.load_model(spark, folder, "isolation_forest", 1)[0], "isolation_forest")
    assert len(got) == 60 and (got < 0).all()


def test_evaluation(spark):
    rows = [(True, True)] * 3 + [(True, False)] + [(False, True)] * 2 + [(False, False)] * 4
    e = novelty.evaluate(spark.createDataFrame(rows, "is_anomaly boolean, label boolean")).first()
    assert (e.tp, e.fp, e.fn, e.tn) == (3, 1, 2, 4)
    assert (e.accuracy, e.precision, e.recall, e.f1_score) == pytest.approx((0.7, 0.75, 0.6, 2 / 3))


def test_term_weights_reach_the_models(spark, tiny):
    rows = tables.logs(spark, tiny)
    fitted = features.fit_features(rows, max_terms=20)
    v = novelty.model_vectors(rows, fitted)
    sample = novelty.training_rows(v, terms=20, max_samples=300)
    width = len(sample.first().features)
    assert width == len(v.first().features) + 20
    tabs = novelty.fit_models(sample)
    out = novelty.score_ensemble(v, tabs, novelty.fit_thresholds(sample, tabs))
    r = out.agg(F.count("*"), F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert r[0] == rows.count() and 0 <= r[1] <= r[2] <= 1
    names = novelty.vector_names(novelty.category_sizes(fitted["categories"]), terms=20)
    assert len(names) == width and names[-1] == "text_tfidf_19"


def test_rank_normalise_does_not_saturate(spark):
    df = spark.range(1000).select((-F.col("id").cast("double")).alias("raw"))
    out = scoring.rank_normalise(df, "raw", "score").agg(F.min("score"), F.max("score"), F.avg("score")).first()
    assert out[0] <= 0.01 and out[1] >= 0.99 and abs(out[2] - 0.5) < 0.01


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.93, 1.0])
@pytest.mark.parametrize("buckets", [2, 1024])
def test_exact_quantile(spark, q, buckets):
    from alertflow.functions.quantile import exact_quantiles

    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=300), np.full(500, 0.25), [1e300, -1e300, 5e-324, 0.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": v, "w": np.where(v > 0, v, np.nan), "x": None}), "v double, w double, x double").repartition(5)
    got = exact_quantiles(df, {"a": ("v", q), "b": ("w", q), "c": ("x", q)}, buckets)
    assert got["a"] == pytest.approx(np.quantile(v, q), rel=1e-12, abs=1e-300)
    assert got["b"] == pytest.approx(np.quantile(v[v > 0], q), rel=1e-12)
    assert got["c"] is None
