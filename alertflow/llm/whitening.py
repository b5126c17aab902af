"""Whitening of embeddings: leading eigenvectors of their covariance by Chebyshev-filtered subspace iteration.

Only products of the covariance with a thin block are distributed: each pass reads the fit list once, and what a task
gives back has (dimensions x columns of the block) cells, which are summed before they reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import saved, small_batches

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Largest residual of a component, as a part of the largest eigenvalue; smaller eigenvalues are held to RELATIVE of their own.
TOLERANCE, RELATIVE, ROUNDING = 1e-13, 1e-5, 4e-15
#: Eigenvalues below this part of the largest count as zero: such directions have no component.
LEAST = 1e-10
#: Degree of a filter, columns of the final probe, passes after which the result counts as not certified, seed.
DEGREE, PROBE, MOST_PASSES, SEED = 16, 4, 1000, 5
ROWS = 4096
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Fit list size, exact sums per dimension, eigenvalues (falling), eigenvectors (columns), share of the variance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def _entries(column: pa.Array, size: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable vectors of a batch and their rounded entries, all of ``size`` if that is given."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * entries)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < 2.0**62))])
    ends = np.cumsum(lengths)
    fits = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    if size is not None:
        fits &= lengths == size
    at = np.flatnonzero(fits)
    scaled[~(np.abs(scaled) < 2.0**62)] = 0
    whole = scaled.astype(np.int64) + SHIFT
    return at, [whole[e - n : e] for e, n in zip(ends[at].tolist(), lengths[at].tolist(), strict=True)]


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, found = _entries(batch.column("vector"))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64()))], names=["x"])


def narrow_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    small_batches(rows.sparkSession)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def fit_list(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each distinct rounded vector once, as ``x``. Copies meet in the partial aggregate of each task."""
    return narrow_vectors(rows, id_col, vector_col).select("vector").mapInArrow(_rounded, "x array<long>").distinct()


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, size)


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: in 64 bits where that fits, else in whole numbers of any size."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most < 1 << 62 and max(map(abs, sums.tolist()), default=0) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _exact(x, n, sums).astype(np.float64) / n


def _sums(size: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        for batch in batches:
            x = _matrix(batch, size)
            small = int(np.abs(x).max(initial=0)) < 1 << 40
            total = total + (x.sum(0) if small else x.astype(object).sum(0))
        values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), values], names=["dim", "s"])

    return sums


def _over(fit: DataFrame, size: int, cells: tuple[int, int], work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``work`` (an array of ``cells``) over the blocks of the fit list, cell by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            x = _matrix(batch, size)
            for at in range(0, len(x), ROWS):
                total += work(x[at : at + ROWS])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"]
        )

    found = fit.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(cells[0] * cells[1])
    out[found.column("cell").to_numpy()] = found.column("value").to_numpy()
    return out.reshape(cells)


def _basis(columns: np.ndarray, locked: np.ndarray) -> np.ndarray:
    """Orthonormal columns, at right angles to ``locked``; done twice, as once leaves rounding."""
    for _ in range(2):
        columns = np.linalg.qr(columns - locked @ (locked.T @ columns))[0]
    return columns


def _ritz(q: np.ndarray, aq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: values (falling), vectors, products and residual norms."""
    h = q.T @ aq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, aq = q @ turn, aq @ turn
    return values, q, aq, np.linalg.norm(aq - q * values, axis=0)


def chebyshev_subspace(
    product: Callable[[np.ndarray], np.ndarray], size: int, k: int, block: int | None = None, seed: int = SEED,
    degree: int = DEGREE, most_passes: int = MOST_PASSES,
) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues and vectors of a symmetric positive semidefinite operator, and the passes it took.

    ``product(Y)`` gives the operator times a block. Each round applies a Chebyshev polynomial that stays within 1 on
    the unwanted part [low, cut] of the spectrum and grows fast above it, then QR and Rayleigh-Ritz. The product that
    Rayleigh-Ritz needs is the next filter's first step, so a filter of degree m costs m passes. A leading pair is locked
    once its residual is within the tolerance. At the end a fresh random block, filtered beside the locked vectors,
    must hold nothing above the least locked value; otherwise the search goes on.
    """
    rng = np.random.default_rng(seed)
    k = min(k, size)
    block = min(size, block or 2 * k)
    locked, locked_a, tops = np.empty((size, 0)), np.empty((size, 0)), np.empty(0)
    q = _basis(rng.standard_normal((size, block)), locked)
    aq, passes, low, first, probing = product(q), 1, math.inf, True, False
    while True:
        values, q, aq, residual = _ritz(q, aq)
        largest = max(values[0], tops.max(initial=0.0), 0.0)
        low = max(0.0, min(low, values[-1] - residual[-1]))
        if probing and values[0] > tops.min() * (1 + 1e-9) + ROUNDING * largest:
            behind = tops < values[0]  # something larger was missed: those below it are searched again
            q, aq = np.hstack([q, locked[:, behind]]), np.hstack([aq, locked_a[:, behind]])
            locked, locked_a, tops = locked[:, ~behind], locked_a[:, ~behind], tops[~behind]
            probing = False
            q = _basis(q, locked)
            aq, passes = product(q), passes + 1
            continue
        if probing:
            break
        limit = np.maximum(np.minimum(TOLERANCE * largest, RELATIVE * np.abs(values)), ROUNDING * largest)
        done = 0
        while done < len(values) and len(tops) + done < k and residual[done] <= limit[done]:
            done += 1
        locked, locked_a = np.hstack([locked, q[:, :done]]), np.hstack([locked_a, aq[:, :done]])
        tops = np.concatenate([tops, values[:done]])
        q, aq, values, residual = q[:, done:], aq[:, done:], values[done:], residual[done:]
        if len(tops) and len(values) and values[0] < LEAST * largest:
            k = len(tops)  # the rest counts as zero
        if len(tops) >= k:
            if locked.shape[1] == size:
                break
            cut = max(low, min(tops.min(), values[0] if len(values) else tops.min()))
            q = _basis(rng.standard_normal((size, min(PROBE, size - k))), locked)
            aq, passes, probing = product(q), passes + 1, True
        else:
            cut = values[(k - len(tops) + len(values)) // 2 if first and block < size else -1]
            cut -= 0.05 * (cut - low)
        first = False
        if passes > most_passes:
            raise RuntimeError(f"not certified after {passes} passes: residuals {residual[:k].tolist()}")
        # a filter that lifts the first direction by more than 1e8 would drown the others in its rounding
        above = max(cut, (values[0] if len(values) and not probing else cut))
        cut = max(cut, low + (above - low) / 5000)
        centre, half = (cut + low) / 2, max((cut - low) / 2, 1e-12 * largest, 1e-300)
        reach = max((above - centre) / half, 1 + 1e-6)
        steps = 8 if probing else max(2, min(degree, int(math.log(1e8) / math.acosh(reach))))
        before, now = q, (aq - centre * q) / half
        for _ in range(steps - 1):
            now -= locked @ (locked.T @ now)
            before, now = now, 2 / half * (product(now) - centre * now) - before
            passes += 1
            size_of = np.linalg.norm(now, axis=0).max()
            before, now = before / size_of, now / size_of
        q = _basis(now / np.maximum(np.linalg.norm(now, axis=0), 1e-300), locked)
        aq, passes = product(q), passes + 1
    values, vectors, _, _ = _ritz(locked, locked_a)
    return values, vectors, passes


def fit_whitening(fit: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on a written fit list (column ``x``); None if it holds no vector.

    Vectors of another length than the one most vectors have (of equal counts the greater) are left out.
    """
    lengths = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if lengths is None:
        return None
    size, n = lengths["size"], lengths["count"]
    fit = fit.where(F.size("x") == size)
    found = fit.mapInArrow(_sums(size), "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    sums = np.array([int(r["s"]) for r in sorted(found, key=lambda r: r["dim"])], object)
    total = _over(fit, size, (1, size), lambda x: np.square(_centred(x, n, sums)).sum(0)[None, :])
    trace = float(total.sum()) / n

    def product(y: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ y)

        return _over(fit, size, y.shape, work) / n

    if not trace > 0:
        none = np.empty(0)
        return Whitening(n, tuple(sums.tolist()), none, np.empty((size, 0)), none, 0.0, 0)
    values, vectors, passes = chebyshev_subspace(product, size, k)
    real = values > LEAST * values[0]
    values, vectors = values[real], vectors[:, real]
    # either sign holds; the largest entry is made positive, so a rerun agrees
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    turn = vectors / np.sqrt(values)

    def covariance(x: np.ndarray) -> np.ndarray:
        z = _centred(x, n, sums) @ turn
        return z.T @ z

    error = np.abs(_over(fit, size, (len(values), len(values)), covariance) / n - np.eye(len(values))).max()
    return Whitening(n, tuple(sums.tolist()), values, vectors, values / trace, float(error), passes)


def _deviations(exact: np.ndarray) -> pa.Array:
    most = max(int(np.abs(exact).max(initial=0)), 1)
    if exact.dtype != object and exact.shape[1] * most * most < 1 << 62:
        return pa.array((exact * exact).sum(1)).cast(pa.decimal128(38, 0))
    exact = exact.astype(object)
    return pa.array([Decimal(int(v)) for v in (exact * exact).sum(1)], pa.decimal128(38, 0))


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component; the model is (dimensions x components) numbers and travels with the tasks."""
    size, k = model.vectors.shape
    turn, sums = model.vectors / np.sqrt(model.values), np.array(model.sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = _entries(batch.column("vector"), size)
            if not len(at) or not k:
                continue
            x = np.vstack(found)
            exact = _exact(x, model.n, sums)
            white = exact.astype(np.float64) / model.n @ turn
            times = np.repeat(np.arange(len(at)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at[times])),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(times), model.n, np.int64)),
                    _deviations(exact).take(pa.array(times)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, len(at))),
                    pa.array(np.full(len(times), model.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return narrow_vectors(rows, id_col, vector_col).mapInArrow(run, OUT)


def whitened_embeddings(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Fit on all distinct vectors and whiten every row: columns as in ``OUT``.

    Entries become floor(64 c) + 1000000. Rows with a null or empty vector, null or non-finite entries, entries whose
    rounded value does not fit 64 bits, or another number of entries than most vectors have are left out. Repeated vectors
    count once in the fit and are all returned; null and repeated ids are returned like others; other columns are
    ignored. There are as many components as the covariance has eigenvalues above 1e-10 of the largest, 16 at most: none
    where all vectors are equal. An empty table gives an empty result. ``deviation`` is exact up to 38 digits.
    """
    model = fit_whitening(saved(fit_list(rows, id_col, vector_col), "fit-list"), k)
    if model is None:
        return rows.sparkSession.createDataFrame([], OUT)
    return whiten(rows, model, id_col, vector_col)
