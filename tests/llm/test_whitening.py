"""Whitening against numpy over whole tables, odd rows, and subspace iteration on known spectra."""

import math
from decimal import Decimal

import numpy as np
import pytest

from alertflow.llm import registry, whitening


def brute(vectors):
    """Per row: entries, deviation and whitened values of up to 16 components up to sign; explained; n."""
    x = [None if v is None or not len(v) or any(c is None or not math.isfinite(c) for c in v) else tuple(math.floor(64 * float(c)) + 10**6 for c in v) for v in vectors]
    fit = np.array(sorted(set(v for v in x if v is not None)), np.int64)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(16, int((e > 1e-10 * max(e[0], 0)).sum()))
    out = [None if r is None else (sum((n * a - int(b)) ** 2 for a, b in zip(r, s, strict=True)), (n * np.array(r) - s) / n @ u[:, :k] / np.sqrt(e[:k])) for r in x]
    return out, e[:k] / np.trace(v), n


def check(got, ids, vectors):
    want, explained, n = brute(vectors)
    k = len(explained)
    by_row = sorted((i, w) for i, w in zip(ids, want, strict=True) if w is not None)
    got = sorted(got, key=lambda r: (r.vec_id, r.component))
    assert len(got) == k * len(by_row)
    white = np.array([r.whitened for r in got]).reshape(-1, k)
    sign = np.sign((white * np.array([w[1] for _, w in by_row])).sum(0))
    assert np.abs(white * sign - np.array([w[1] for _, w in by_row])).max() < 1e-8
    for j, (i, w) in enumerate(by_row):
        rows = got[j * k : (j + 1) * k]
        assert [r.vec_id for r in rows] == [i] * k and [r.component for r in rows] == list(range(1, k + 1))
        assert {(r.n, int(r.deviation)) for r in rows} == {(n, w[0])}
        assert np.allclose([r.explained for r in rows], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query_on_the_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    query = registry.queries()["op11_embedding_whitening"](spark, small)
    assert dict(query.dtypes)["deviation"] == "bigint"
    check(query.collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(x) for x in v] for v in rng.normal(0, 1, (60, 5))]
    good += [good[0]] * 40 + [good[1]]
    odd = [None, [], [None, 1.0, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [(k, v, "a", k, "d") for k, v in enumerate(good + odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, component int, deviation string").repartition(4)
    vectors = good + [None] * len(odd)
    check(whitening.whitened_embeddings(frame).collect(), range(len(rows)), vectors)
    twice = frame.select("embedding", "vec_id").union(spark.createDataFrame([(good[2], None)], "embedding array<double>, vec_id long"))
    assert sum(r.vec_id is None for r in whitening.whitened_embeddings(twice).collect()) == 5
    assert whitening.whitened_embeddings(frame.limit(0)).count() == 0
    assert whitening.whitened_embeddings(frame.where("vec_id >= 101")).columns == whitening.whitened_embeddings(frame).columns
    assert whitening.whitened_embeddings(spark.createDataFrame([(1, [2.0, 3.0]), (2, [2.0, 3.0])], "vec_id long, embedding array<double>")).count() == 0


def test_large_entries_stay_exact(spark):
    vectors = [[1e12, 0.0], [-1e12, 1.0], [3e11 + 1, 5.0]]
    frame = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whitened_embeddings(frame).collect()}
    assert got == {i: Decimal(w[0]) for i, w in enumerate(brute(vectors)[0])}


@pytest.mark.parametrize(
    "spectrum",
    [
        np.ones(40), np.r_[np.full(20, 5.0), np.full(40, 1.0)], 10.0 ** -np.arange(50.0), np.r_[3.0, 2, 1, np.zeros(47)],
        np.r_[np.linspace(9, 5, 15), np.full(45, 2.0)], np.array([3.0, 1.0]), np.linspace(2, 1, 300), np.r_[1e6, np.linspace(2, 1, 80)],
    ],
)
def test_known_spectra(spectrum):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    a = (q * spectrum) @ q.T
    values, vectors, _ = whitening.chebyshev_subspace(lambda y: a @ y, len(spectrum), 16)
    top = np.sort(spectrum)[::-1][: len(values)]
    assert len(values) >= min(16, len(spectrum), int((spectrum > 1e-9 * spectrum.max()).sum()))
    assert np.abs(values - top).max() < 1e-12 * spectrum.max()
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-12 * spectrum.max()


def test_a_missed_direction_is_found_by_the_probe(monkeypatch):
    """The first block is at right angles to the largest direction, so only the probe can meet it."""
    spectrum = np.r_[10.0, np.linspace(5, 1, 39)]
    first = np.random.default_rng

    class Blind:
        def __init__(self, seed):
            self.inner, self.calls = first(seed), 0

        def standard_normal(self, shape):
            self.calls += 1
            out = self.inner.standard_normal(shape)
            if self.calls == 1:
                out[0] = 0
            return out

    monkeypatch.setattr(whitening.np.random, "default_rng", Blind)
    values, _, _ = whitening.chebyshev_subspace(lambda y: spectrum[:, None] * y, 40, 4, block=8)
    assert np.allclose(values, [10, *spectrum[1:4]])
