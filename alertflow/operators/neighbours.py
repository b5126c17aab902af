"""Exact k-nearest-neighbour join: space is cut into cells, tasks search cells by a tree.

A tree over drawn rows cuts space into cells that a task can hold. In a first round a query searches a block of its own
cell, which leaves its nearest rows there and a bound for all others; in a second round only queries whose bound reaches
into the box of another cell are sent there. Inside a task, references lie in the leaves of a tree of their own, and
batches of nearby queries meet them leaf by leaf from the nearest on, by matrix products that only exclude: what they
leave is measured by differences. Where distances tell nothing every cell is visited: a query is then copied once a cell,
and cells are as large as a task can hold. The drawn rows and the boxes of cells are all that reaches the driver, and
their number is bounded; neither changes the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertflow.session import stored

#: Rows of a leaf of a task's tree at most, most cells, least queries of a task.
CELL_ROWS, MOST_CELLS, BLOCK = 1000, 4096, 2048
#: Bytes of references that a task holds, drawn rows for a cell and in all.
TASK_BYTES, DRAWN, MOST_DRAWN = 64 << 20, 64, 16_384
#: Rows taken from an Arrow batch at a time, leaf rows whatever is asked for, queries of a batch, references of its first
#: step and of later ones.
ROW_CHUNK, LEAF, BATCH, FIRST, STEP = 1000, 256, 256, 512, 4096


# -- space ------------------------------------------------------------------------


@dataclass(frozen=True)
class Cuts:
    """A binary tree over space: (feature, cut, low, high) by node; a leaf has feature -1 and its number in ``low``."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def find(self, x: np.ndarray) -> np.ndarray:
        at, inner = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(inner := inner[self.feature[at[inner]] >= 0]):
            node = at[inner]
            goes_low = x[inner, self.feature[node]] <= self.cut[node]
            at[inner] = np.where(goes_low, self.low[node], self.high[node])
        return self.low[at]


def _split(part: np.ndarray) -> tuple[int, float] | None:
    """Where to cut: the widest entry, at the largest gap near its middle; None if all rows are equal."""
    differ = part.max(axis=0) > part.min(axis=0)
    if not differ.any():
        return None
    f = int(np.where(differ, part.var(axis=0), -1.0).argmax())
    v = np.sort(part[:, f])
    low, high = int(0.3 * len(v)), max(int(0.7 * len(v)), int(0.3 * len(v)) + 1)
    gaps = np.diff(v[low : high + 1])
    if len(gaps) and gaps.max() > 0:
        p = low + int(gaps.argmax())
    else:
        steps = np.flatnonzero(np.diff(v) > 0)
        p = int(steps[np.abs(steps - len(v) / 2).argmin()])
    cut = float(v[p] + (v[p + 1] - v[p]) / 2)
    return f, cut if v[p] <= cut < v[p + 1] else float(v[p])


def cut_space(x: np.ndarray, leaf: int) -> Cuts:
    """Cuts until a leaf has at most ``leaf`` of the rows or only equal ones; leaves are numbered from left to right."""
    nodes: list[list] = []
    leaves, work = 0, [(np.arange(len(x)), None, 0)]
    while work:
        rows, parent, side = work.pop()
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1])
        if parent is not None:
            nodes[parent][2 + side] = me
        part = x[rows]
        found = _split(part) if len(rows) > leaf else None
        if found is None:
            nodes[me][2], leaves = leaves, leaves + 1
            continue
        f, cut = found
        left = part[:, f] <= cut
        nodes[me][:2] = f, cut
        work.append((rows[~left], me, 1))
        work.append((rows[left], me, 0))
    kinds = (np.int64, float, np.int64, np.int64)
    return Cuts(*[np.array([n[i] for n in nodes], t) for i, t in enumerate(kinds)])


def box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Square distance of every row to every box, zero inside."""
    gap = np.maximum(low[None] - x[:, None], x[:, None] - high[None])
    np.maximum(gap, 0.0, out=gap)
    return np.einsum("ijk,ijk->ij", gap, gap)


# -- search inside a task -------------------------------------------------------------


class Search:
    """References of a task, in order of their id, by the leaves of a tree."""

    def __init__(self, y: np.ndarray, leaf: int, k: int):
        whole = np.flatnonzero(np.isfinite(y).all(axis=1))
        y = y[whole]
        self.cuts = cut_space(y, leaf)
        at = self.cuts.find(y)
        order = np.argsort(at, kind="stable")
        size = np.bincount(at, minlength=at.max(initial=-1) + 1)
        starts = np.cumsum(size) - size
        keep = np.ones(len(order), bool)
        boxes = []
        for s, n in zip(starts, size):
            part = y[order[s : s + n]]
            boxes.append((part.min(axis=0), part.max(axis=0)))
            # of equal rows no more than k, the first by id, can be among anybody's k nearest
            if n > k and (boxes[-1][0] == boxes[-1][1]).all():
                keep[s + k : s + n] = False
        self.size = np.minimum(size, np.add.reduceat(keep, starts)) if len(size) else size
        self.starts = np.cumsum(self.size) - self.size
        order = order[keep]
        self.y, self.place = y[order], whole[order]
        self.low, self.high = (np.array(b).reshape(-1, y.shape[1]) for b in (zip(*boxes) if boxes else ((), ())))
        self.widest = np.abs(y).max(initial=0.0)

    def nearest(self, x: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, distance) of the ``k`` nearest references within ``bound`` of each row, ties by place."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        rows = np.flatnonzero(np.isfinite(x).all(axis=1)) if len(self.y) else np.empty(0, np.int64)
        rows = rows[np.argsort(self.cuts.find(x[rows]), kind="stable")]
        for low in range(0, len(rows), BATCH):
            part = rows[low : low + BATCH]
            q, r, d = self._batch(x[part], k, bound[part])
            q, r = part[q], self.place[r]
            order = np.lexsort((r, d, q))
            order = order[_copies(np.unique(q, return_counts=True)[1])[1] < k]
            out.append((q[order], r[order], d[order]))
        q, r, d = (np.concatenate(v) for v in zip(*out))
        order = np.argsort(q, kind="stable")
        return q[order], r[order], d[order]

    def _rows_of(self, leaves: np.ndarray) -> np.ndarray:
        leaf, n = _copies(self.size[leaves])
        return self.starts[leaves][leaf] + n

    def _batch(self, x: np.ndarray, k: int, bound: np.ndarray):
        """Leaves from the nearest on, in growing steps; after each, the k-th distance so far limits the next.

        A product around the rows' own middle, in single precision where numbers allow, gives a lower bound of each square
        distance; ``slack`` covers its rounding for any number of entries. What it leaves is measured by differences.
        """
        n, width = x.shape
        limit = (bound * (1 + 1e-12)) ** 2
        low, high, centre = x.min(axis=0), x.max(axis=0), x.mean(axis=0)
        kind = np.float32 if np.abs(x - centre).max() + np.abs(centre).max() + self.widest < 1e15 else np.float64
        slack = (width + 8) * 2.0 * float(np.finfo(kind).eps)
        # the squares of both sides are two more columns of the product
        left = np.ones((n, width + 2), kind)
        left[:, :width] = x - centre
        na = np.einsum("ij,ij->i", left[:, :width], left[:, :width])
        left[:, :width] *= kind(-2.0)
        left[:, width + 1] = na * kind(1 - slack)
        away = box_distances(low[None], self.low - (high - low), self.high)[0]
        order = np.argsort(away, kind="stable")
        away, total = away[order], np.cumsum(self.size[order])
        q, r, least, most = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.float32)
        at, step, look = 0, max(FIRST, 2 * k), True
        while at < len(order) and away[at] <= limit.max():
            done = total[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(total, done + step, side="left")) + 1)
            stop = max(at + 1, min(stop, int(np.searchsorted(away, limit.max(), side="right"))))
            leaves, at, step = order[at:stop], stop, min(2 * step, STEP)
            parts = [(np.arange(n), slice(0, None))]
            if look and np.isfinite(limit).any():
                reach = box_distances(x, self.low[leaves], self.high[leaves]) <= limit[:, None]
                share, used = reach.mean(), reach.any(axis=0)
                look = share < 0.8
                if share < 0.4:
                    leaves, reach = leaves[used], reach[:, used]
                    ends = np.cumsum(self.size[leaves])
                    parts = [(np.flatnonzero(reach[:, j]), slice(e - m, e)) for j, (e, m) in enumerate(zip(ends, self.size[leaves]))]
            if not parts:
                continue
            here = self._rows_of(leaves)
            right = np.ones((width + 2, len(here)), kind)
            right[:width] = (self.y[here] - centre).T
            nb = np.einsum("ij,ij->j", right[:width], right[:width])
            right[width] = nb * kind(1 - slack)
            new = [self._hits(left, right, rows, columns, k, limit, slack, na, nb) for rows, columns in parts]
            row, place, found = (np.concatenate(v) for v in zip(*new))
            upper = found + kind(2 * slack) * (na[row] + nb[place]) + kind(1e-30)
            old = (q, r, least, most)
            q, r, least, most = (np.concatenate(both) for both in zip(old, (row, here[place], found, _above(upper))))
            # a row's number and an upper bound in single precision are one whole number
            by = np.argsort((q.astype(np.uint64) << np.uint64(32)) | most.view(np.uint32))
            sizes = np.bincount(q, minlength=n)
            kth = np.full(n, np.inf)
            kth[sizes >= k] = most[by[(np.cumsum(sizes) - sizes + k - 1)[sizes >= k]]]
            limit = np.minimum(limit, kth)
            kept = least <= kth[q]
            q, r, least, most = q[kept], r[kept], least[kept], most[kept]
        d = np.empty(len(q))
        for low in range(0, len(q), 16_384):
            part = slice(low, low + 16_384)
            d[part] = np.sqrt(((x[q[part]] - self.y[r[part]]) ** 2).sum(axis=1))
        return q, r, d

    @staticmethod
    def _hits(left, right, rows, columns, k, limit, slack, na, nb):
        """(row, column, lower bound) where the lower bound is within the limit, or else among the ``k`` least."""
        low = left[rows] @ right[:, columns]
        most = limit[rows]
        if low.shape[1] >= k and np.isinf(most).any():
            kth = np.partition(low, k - 1, axis=1)[:, k - 1].astype(float)
            most = np.minimum(most, kth + 2.0 * slack * (na[rows].astype(float) + float(nb[columns].max())))
        with np.errstate(over="ignore"):
            most = (most * (1 + 1e-6) + 1e-30).astype(low.dtype)
        at = np.flatnonzero(low <= most[:, None])
        row, column = np.divmod(at, low.shape[1])
        return rows[row], column + (columns.start or 0), low.ravel()[at]


def _above(x: np.ndarray) -> np.ndarray:
    """Numbers of single precision that are not below ``x`` and not negative."""
    with np.errstate(over="ignore"):
        return np.nextafter(np.maximum(x, 0).astype(np.float32), np.float32(np.inf))


# -- rows and cells ----------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of numbers; a null entry is NaN and a missing row has nothing else."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        out = np.full((len(column), width), np.nan)
        there = column.is_valid().to_numpy(zero_copy_only=False)
        out[there] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return out
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _hash(ids: pa.ChunkedArray | pa.Array, seed: int) -> np.ndarray:
    ids = ids.fill_null(0) if pa.types.is_integer(ids.type) else ids
    values = ids.to_pandas().to_numpy()
    return pd.util.hash_array(values, hash_key=f"{seed:016d}").astype(np.uint64) if len(values) else np.empty(0, np.uint64)


@dataclass(frozen=True)
class Cells:
    """The cuts of space, rows and boxes (lowest and highest entries) of its cells; all that a task needs to route a row."""

    cuts: Cuts
    rows: np.ndarray
    boxes: tuple[np.ndarray, np.ndarray]
    block: int

    @property
    def blocks(self) -> np.ndarray:
        return -(-self.rows // self.block)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row; where a cell has no references, the largest."""
        at = self.cuts.find(x)
        return np.where(self.rows[at] > 0, at, self.rows.argmax())

    def distances(self, x: np.ndarray) -> np.ndarray:
        parts = [box_distances(x[:, low : low + 8], *(b[:, low : low + 8] for b in self.boxes)) for low in range(0, x.shape[1], 8)]
        return np.where(self.rows > 0, sum(parts), np.inf)

    def loose_bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """Some cell of at least ``k`` rows lies within this distance as a whole."""
        out = np.full(len(x), np.inf)
        for low, high in zip(*(b[self.rows >= k] for b in self.boxes)):
            far = np.maximum(np.abs(x - low), np.abs(x - high))
            out = np.fmin(out, np.sqrt((far * far).sum(axis=1)))
        return out

    def reachable(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells may hold a row within ``bound``, one row of flags per query."""
        whole = np.isfinite(x).all(axis=1)[:, None]
        with np.errstate(invalid="ignore"):
            return whole & (self.distances(x) <= ((bound * (1 + 1e-12)) ** 2)[:, None]) & (self.rows > 0)


def _pivots(refs: DataFrame, n: int, seed: int) -> np.ndarray:
    """``n`` rows by the smallest hash; which ones they are changes the work, never the result."""
    h = F.xxhash64(F.col("id").cast("string"), F.lit(seed))
    rows = refs.orderBy(h, "id").limit(n).select("features").collect()
    return np.array([r["features"] for r in rows if r["features"] is not None], dtype=float)


def _assigned(rows: DataFrame, pivots: np.ndarray, per_cell: int = 1) -> DataFrame:
    """Rows with the number of their cell, where space is cut until a cell has ``per_cell`` of the pivots."""
    cuts, width = cut_space(pivots[np.isfinite(pivots).all(axis=1)], per_cell), pivots.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cuts.find(_matrix(b.column("features"), width)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("features"), pa.array(cell)], names=["id", "features", "cell"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "features").mapInArrow(assign, f"id {id_type}, features array<double>, cell int")


def _measured(refs: DataFrame, cuts: Cuts, block: int, width: int) -> Cells:
    """Rows and boxes of the cells, from one row per task and cell."""
    n = int(cuts.low[cuts.feature < 0].max()) + 1

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, low, high = np.zeros(n, np.int64), np.full((n, width), np.inf), np.full((n, width), -np.inf)
        for b in batches:
            x = _matrix(b.column("features"), width)
            x = x[np.isfinite(x).all(axis=1)]
            cell = cuts.find(x)
            order = np.argsort(cell, kind="stable")
            there, start, size = np.unique(cell[order], return_index=True, return_counts=True)
            if len(there):
                rows[there] += size
                low[there] = np.minimum(low[there], np.minimum.reduceat(x[order], start, axis=0))
                high[there] = np.maximum(high[there], np.maximum.reduceat(x[order], start, axis=0))
        yield _boxes(rows, low, high)

    def merged(part: pa.Table) -> pa.Table:
        low, high = (_matrix(part.column(c), width) for c in ("low", "high"))
        cell = np.array([part.column("cell")[0].as_py()])
        rows = np.array([part.column("n").to_numpy().sum()])
        return pa.Table.from_batches([_boxes(rows, low.min(axis=0)[None], high.max(axis=0)[None], cell)])

    schema = "cell int, n long, low array<double>, high array<double>"
    found = refs.select("features").mapInArrow(extent, schema).groupBy("cell").applyInArrow(merged, schema)
    rows, low, high = np.zeros(n, np.int64), np.full((n, width), np.inf), np.full((n, width), -np.inf)
    for c in found.collect():
        rows[c["cell"]], low[c["cell"]], high[c["cell"]] = c["n"], c["low"], c["high"]
    return Cells(cuts, rows, (low, high), block)


def _boxes(rows: np.ndarray, low: np.ndarray, high: np.ndarray, cell: np.ndarray | None = None) -> pa.RecordBatch:
    at = np.flatnonzero(rows)
    entries = [_lists(pa.array(v[at].ravel()), np.full(len(at), v.shape[1])) for v in (low, high)]
    numbers = pa.array((at if cell is None else cell[at]).astype(np.int32))
    return pa.RecordBatch.from_arrays([numbers, pa.array(rows[at]), *entries], names=["cell", "n", "low", "high"])


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _visits(queries: DataFrame, cells: Cells, pick: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Queries that visit each cell, counted where they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells.rows), np.int64)
        for whole in batches:
            for low in range(0, whole.num_rows, ROW_CHUNK):
                total += pick(whole.slice(low, ROW_CHUNK)).sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(len(cells.rows), np.int64)
    for r in queries.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _routed(rows: DataFrame, route: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], extra: str) -> DataFrame:
    """Copies of the rows for each (cell, block, chunk) that ``route`` names by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROW_CHUNK):
                b = whole.slice(start, ROW_CHUNK)
                at, cell, block, chunk = route(b)
                for low in range(0, len(at), 4 * BLOCK):
                    part = slice(low, low + 4 * BLOCK)
                    taken = b.take(pa.array(at[part]))
                    columns = [pa.array(v[part].astype(np.int32)) for v in (cell, block, chunk)]
                    yield pa.RecordBatch.from_arrays([*taken.columns, *columns], names=[*taken.schema.names, "cell", "block", "chunk"])

    return rows.mapInArrow(run, f"{extra}, cell int, block int, chunk int")


def _meet(
    queries, refs, cells: Cells, chunks: np.ndarray, pick, every_block: bool, work, schema: str, query_kind: str, ref_kind: str,
    seen: bool = False,
) -> DataFrame:
    """Queries and references meet per (cell, block, chunk), none of which holds much more than a block of either.

    With ``seen``, queries have a (home, part) that they met before and that is left out.
    """
    blocks = cells.blocks

    def of_refs(b: pa.RecordBatch):
        cell = b.column("home").to_numpy()
        block = (_hash(b.column("id"), 1) % np.maximum(blocks[cell], 1).astype(np.uint64)).astype(np.int64)
        at, chunk = _copies(np.where(blocks[cell] > 0, chunks[cell], 0))
        return at, cell[at], block[at], chunk

    def of_queries(b: pa.RecordBatch):
        at, cell = np.nonzero(pick(b))
        h = _hash(b.column("id"), 2)[at]
        chunk = (h % np.maximum(chunks[cell], 1).astype(np.uint64)).astype(np.int64)
        if every_block:
            each, block = _copies(blocks[cell])
            at, cell, chunk = at[each], cell[each], chunk[each]
            if seen:
                new = (cell != b.column("home").to_numpy()[at]) | (block != b.column("part").to_numpy()[at])
                at, cell, block, chunk = at[new], cell[new], block[new], chunk[new]
            return at, cell, block, chunk
        block = ((h >> np.uint64(20)) % np.maximum(blocks[cell], 1).astype(np.uint64)).astype(np.int64)
        return at, cell, block, chunk

    keys = ["cell", "block", "chunk"]
    q = _routed(queries, of_queries, query_kind)
    r = _routed(refs.select("id", "features", F.col("cell").alias("home")), of_refs, f"{ref_kind}, home int")
    return q.groupBy(*keys).cogroup(r.drop("home").groupBy(*keys)).applyInArrow(work, schema)


def _copies(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and number of each copy, where position i is copied ``times[i]`` times."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


# -- the join ----------------------------------------------------------------------------


def knn_lists(
    queries: DataFrame, refs: DataFrame, k: int, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS,
    block: int = BLOCK, seed: int = 42, task_rows: int | None = None,
) -> DataFrame:
    """(id, near): for every row of ``queries`` an array of (d, other), the ``k`` nearest of ``refs`` in order of (d, other).

    Rows that find nothing have no list. A task holds about ``task_rows`` references (by default ``TASK_BYTES`` of them).
    """
    same, spark = queries is refs, queries.sparkSession
    id_type, ref_type = (t.schema["id"].dataType.simpleString() for t in (queries, refs))
    near_type = f"array<struct<d:double,other:{ref_type}>>"
    refs = refs.select("id", "features")
    queries = refs if same else queries.select("id", "features")
    n = refs.count()
    drawn = _pivots(refs, 1, seed) if n and k >= 1 else np.empty(0)
    if not drawn.size:
        return spark.createDataFrame([], f"id {id_type}, near {near_type}")
    width = drawn.shape[1]
    task_rows = task_rows or max(TASK_BYTES // (8 * width), 1)
    n_cells = max(1, min(most_cells, -(-n // task_rows)))
    per_cell = max(1, min(DRAWN, MOST_DRAWN // n_cells))
    pivots = _pivots(refs, n_cells * per_cell, seed)
    refs = _assigned(refs, pivots, per_cell)
    cells = _measured(refs, cut_space(pivots[np.isfinite(pivots).all(axis=1)], per_cell), 2 * task_rows, width)
    if not cells.rows.any():
        return spark.createDataFrame([], f"id {id_type}, near {near_type}")
    rows, blocks, leaf, at_once = cells.rows, cells.blocks, min(cell_rows, LEAF), 2 * spark.sparkContext.defaultParallelism

    def chunked(visits: np.ndarray, per: np.ndarray | int) -> np.ndarray:
        size = min(task_rows, max(block, -(-int(visits.sum()) // at_once)))
        return np.where(rows > 0, np.maximum(-(-visits // (size * np.maximum(per, 1))), 1), 0)

    def home(b):
        x = _matrix(b.column("features"), width)
        out = np.zeros((len(x), len(rows)), bool)
        out[np.arange(len(x)), cells.home(x)] = True
        return out

    def wanted(b):
        x = _matrix(b.column("features"), width)
        return cells.reachable(x, b.column("bound").to_numpy()) if len(x) else np.zeros((0, len(rows)), bool)

    def searched(left: pa.Table, right: pa.Table, bound: np.ndarray):
        right = right.sort_by("id")
        x = _matrix(left.column("features"), width)
        q, r, d = Search(_matrix(right.column("features"), width), leaf, k).nearest(x, k, bound)
        sizes = np.bincount(q, minlength=len(x))
        pairs = pa.StructArray.from_arrays([pa.array(d), right.column("id").combine_chunks().take(pa.array(r))], ["d", "other"])
        return x, q, d, sizes, _lists(pairs, sizes)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        x, q, d, sizes, near = searched(left, right, np.full(left.num_rows, np.inf))
        bound, more = np.full(len(x), np.inf), np.zeros(len(x), bool)
        full = sizes >= k
        bound[full] = d[(np.cumsum(sizes) - 1)[full]]
        cell, part = (left.column(c).to_numpy()[0] if len(x) else 0 for c in ("cell", "block"))
        for low in range(0, len(x), ROW_CHUNK):
            rest = slice(low, low + ROW_CHUNK)
            bound[rest] = np.minimum(bound[rest], cells.loose_bound(x[rest], k)) if not full[rest].all() else bound[rest]
            reach = cells.reachable(x[rest], bound[rest])
            reach[:, cell] &= blocks[cell] > 1
            more[rest] = reach.any(axis=1)
        features = left.column("features").combine_chunks()
        features = features.take(pa.array(np.arange(len(x)), mask=~more))
        same_for_all = [pa.array(np.full(len(x), v, np.int32)) for v in (cell, part)]
        columns = [left.column("id"), features, pa.array(bound), *same_for_all, near]
        return pa.table(columns, names=["id", "features", "bound", "home", "part", "near"])

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        *_, sizes, near = searched(left, right, left.column("bound").to_numpy())
        return pa.table({"id": left.column("id"), "near": near}).filter(pa.array(sizes > 0))

    query_kind = f"id {id_type}, features array<double>"
    ref_kind = f"id {ref_type}, features array<double>"
    state_kind = f"{query_kind}, bound double, home int, part int"
    visits = rows if same else _visits(queries, cells, home)
    found = _meet(queries, refs, cells, chunked(visits, blocks), home, False, first, f"{state_kind}, near {near_type}", query_kind, ref_kind)
    found = stored(found, "near-first")
    again = found.filter(F.col("features").isNotNull())
    # rows of one id share their list; where each has its own, those that go nowhere else are done
    if found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") > 1).isEmpty():
        closed, here = found.filter(F.col("features").isNull()).select("id", "near"), again.select("id", "near")
    else:
        closed, here = None, found.select("id", "near")
    visits = _visits(again, cells, wanted)
    if visits.any():
        state = again.select("id", "features", "bound", "home", "part")
        there = _meet(state, refs, cells, chunked(visits, 1), wanted, True, second, f"id {id_type}, near {near_type}", state_kind, ref_kind, True)
        here = here.union(there)
    if visits.any() or closed is None:
        one = F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)
        here = stored(here.groupBy("id").agg(one.alias("near")), "near-merged")
    return (here if closed is None else closed.union(here)).filter(F.size("near") > 0)


def knn_join(
    queries: DataFrame, refs: DataFrame, k: int, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS,
    block: int = BLOCK, seed: int = 42, task_rows: int | None = None,
) -> DataFrame:
    """(id, other, d, rank): the ``k`` nearest of ``refs`` for every row of ``queries``, ties by ``other``; all, if fewer.

    Both have ``id`` (unique) and ``features`` (array<double> of one length, no nulls). Distances are Euclidean, measured
    by differences. A row of both tables is its own neighbour at distance zero.
    """
    near = knn_lists(queries, refs, k, cell_rows, most_cells, block, seed, task_rows)
    return near.select("id", F.posexplode("near")).select("id", "col.other", "col.d", (F.col("pos") + 1).alias("rank"))
