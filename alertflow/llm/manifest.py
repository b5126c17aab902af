"""Merkle manifest of a dataset: an append log of nodes in postorder, and proofs addressed by position.

A tree over n leaves pairs consecutive nodes level by level; the last node of a level may stand alone and is hashed alone.
Nodes are written when they are complete, children before parents, so a node's place in the log follows from the sizes
of the complete subtrees before it (``position``) and needs no index. Aligned builders do the work: each takes a run of
RUN leaves of one tree and writes its part of the log; the roots of the runs are the leaves of the next round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import ranked, saved

#: A builder's run has 2 ** HEIGHT leaves.
HEIGHT = 10
RUN = 1 << HEIGHT
#: A builder's part of the log: its run of a tree over ``n`` leaves, and its nodes end to end, 32 bytes each.
SEGMENT = "tree long, n long, run long, ids array<long>, changed array<binary>, nodes binary"
PATH = "tree long, run long, path binary, subroot binary"
#: A step on the way up is the side of the sibling and its digest; a node may be alone.
LEFT, RIGHT, ALONE = b"L", b"R", b"-"
DIGEST, STEP = 32, 33
PROOF = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "position long"
)
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def position(height: int, index: int, n: int) -> int:
    """Place in the postorder log of the node ``index`` (from 0) of level ``height`` in a tree over ``n`` leaves.

    m leaves complete 2m - popcount(m) nodes. A node over a whole power of two of leaves comes last of its subtree's
    2^(height+1) - 1 nodes, after all that the leaves before it complete. The others, one per level at the right edge,
    hold the last leaf and follow in order of height.
    """
    before = index << height
    if before + (1 << height) <= n:
        return 2 * before - before.bit_count() + (2 << height) - 2
    lowest = (n & -n).bit_length() - 1
    return 2 * n - n.bit_count() + height - lowest - 1


def height_of(n: int) -> int:
    """Levels above the leaves until one node is left."""
    return (n - 1).bit_length()


def parent(*children: bytes) -> bytes:
    """Digest of the children's digests as hex text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def grow(leaves: list[bytes], levels: int) -> list[bytes]:
    """The postorder log of the tree over ``leaves``, ``levels`` high: each node is appended when it is complete."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(levels + 1)]

    def append(node: bytes, height: int) -> None:
        log.append(node)
        if height < levels:
            open_[height].append(node)
            if len(open_[height]) == 2:
                pair, open_[height] = open_[height], []
                append(parent(*pair), height + 1)

    for leaf in leaves:
        append(leaf, 0)
    for height in range(levels):
        if open_[height]:
            rest, open_[height] = open_[height], []
            append(parent(*rest), height + 1)
    return log


def levels_of(n: int) -> int:
    """Levels a builder adds to its run: to the run's root, or to the root of a tree that is one run."""
    return HEIGHT if n > RUN else height_of(n)


def leaves_of(run: int, n: int) -> int:
    return min(RUN, n - run * RUN)


def steps(log: bytes, index: int, n: int, levels: int) -> bytes:
    """The way up from leaf ``index`` of a run of ``n`` leaves; siblings are read at their place in the run's log."""
    out = []
    for height in range(levels):
        other, count = index ^ 1, -(-n >> height)
        if other < count:
            at = DIGEST * position(height, other, n)
            out.append((LEFT if other < index else RIGHT) + log[at : at + DIGEST])
        else:
            out.append(ALONE + bytes(DIGEST))
        index >>= 1
    return b"".join(out)


def siblings(path: bytes) -> list[bytes]:
    return [path[k + 1 : k + STEP] for k in range(0, len(path), STEP) if path[k : k + 1] != ALONE]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its way up lead to."""
    for k in range(0, len(path), STEP):
        side, other = path[k : k + 1], path[k + 1 : k + STEP]
        leaf = parent(leaf) if side == ALONE else parent(other, leaf) if side == LEFT else parent(leaf, other)
    return leaf


def _piece(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 over the columns in turn: ``-`` for a null, else length in UTF-8 bytes, a colon and the value."""
    return F.unhex(F.sha2(F.concat(*map(_piece, columns)), 256))


def ordered_leaves(rows: DataFrame) -> DataFrame:
    """``rows`` (``tree_of``, ``id``, ``leaf``, ``changed``) with ``tree``, ``n`` and ``index`` of each leaf.

    All rows are ranked at once by tree, id and digest, so a tree that holds most of them is spread like the others. A
    tree is named by the rank of its first leaf.
    """
    rows = saved(ranked(rows, ["tree_of", "id", "leaf"], "rank"), "leaves")
    trees = rows.groupBy(F.col("tree_of").alias("of")).agg(F.min("rank").alias("tree"), F.count("*").alias("n"))
    rows = rows.join(trees, F.col("tree_of").eqNullSafe(F.col("of")))
    return rows.select("tree", "n", (F.col("rank") - F.col("tree")).alias("index"), "id", "leaf", "changed")


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("index")
    n = table.column("n")[0].as_py()
    log = grow(table.column("leaf").to_pylist(), levels_of(n))
    changed = table.column("changed").to_pylist()
    return pa.table(
        {
            "tree": table.column("tree").slice(0, 1),
            "n": table.column("n").slice(0, 1),
            "run": table.column("run").slice(0, 1),
            "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
            "changed": pa.array([changed], pa.list_(pa.binary())),
            "nodes": pa.array([b"".join(log)], pa.binary()),
        }
    )


def append_log(leaves: DataFrame) -> list[DataFrame]:
    """The written log of a forest, one table of segments a round, from ``tree``, ``n``, ``index``, ``id``, ``leaf``, ``changed``.

    A builder has one aligned run of at most RUN leaves, whatever the tree holds. Each round has RUN times fewer leaves.
    """
    rounds = []
    while True:
        runs = leaves.withColumn("run", F.shiftright("index", HEIGHT)).groupBy("tree", "run")
        rounds.append(saved(runs.applyInArrow(_build, SEGMENT), "manifest-log"))
        higher = rounds[-1].where(F.col("n") > RUN)
        if higher.isEmpty():
            return rounds
        leaves = higher.select(
            "tree", F.ceil(F.col("n") / RUN).alias("n"), F.col("run").alias("index"), F.lit(None).cast("long").alias("id"),
            _last(F.col("nodes")).alias("leaf"), F.lit(None).cast("binary").alias("changed"),
        )


def _last(nodes: Column) -> Column:
    return F.substring(nodes, F.octet_length(nodes) - DIGEST + 1, F.lit(DIGEST))


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``tree`` and ``subroot``: the last node of the one segment that a tree's last round has."""
    found = [r.where(F.col("n") <= RUN).select("tree", _last(F.col("nodes")).alias("subroot")) for r in rounds]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ways up of a segment's leaves, which are the runs of the round below."""
    for batch in batches:
        out: dict[str, list] = {"tree": [], "run": [], "path": [], "subroot": []}
        for s in batch.to_pylist():
            n = leaves_of(s["run"], s["n"])
            for k in range(n):
                row = (s["tree"], s["run"] * RUN + k, steps(s["nodes"], k, n, levels_of(s["n"])) + s["path"], s["subroot"])
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def with_paths(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The segments of the first round with the way up from their root, ``path``, and their tree's ``subroot``.

    ``tops`` has ``tree``, ``path`` (the way up from the tree's root) and ``subroot``.
    """
    below = None
    for segments in reversed(rounds):
        paths = segments.where(F.col("n") <= RUN).select("tree", "run").join(tops, "tree").select("tree", "run", "path", "subroot")
        paths = paths if below is None else paths.union(below)
        joined = segments.join(saved(paths, "manifest-paths"), ["tree", "run"])
        below = joined.select("tree", "n", "run", "nodes", "path", "subroot").mapInArrow(_children, PATH)
    return joined


def _prove(root: bytes):
    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for batch in batches:
            for s in batch.to_pylist():
                n, first = leaves_of(s["run"], s["n"]), s["run"] * RUN
                leaves, paths = [], []
                for k in range(n):
                    at = DIGEST * position(0, k, n)
                    leaves.append(s["nodes"][at : at + DIGEST])
                    paths.append(steps(s["nodes"], k, n, levels_of(s["n"])) + s["path"])
                folded = [fold(c or leaf, p) for leaf, c, p in zip(leaves, s["changed"], paths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(s["ids"], pa.int64()),
                        pa.array([x.hex() for x in leaves]),
                        pa.array([s["subroot"].hex()] * n),
                        pa.array([root.hex()] * n),
                        pa.array([sha("".join(x.hex() for x in siblings(p)).encode()) for p in paths]),
                        pa.array([x.hex() for x in folded]),
                        pa.array([x == root for x in folded]),
                        pa.array([position(0, first + k, s["n"]) for k in range(n)], pa.int64()),
                    ],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "position"],
                )

    return prove


def _extract(name: str):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                n = leaves_of(s["run"], s["n"])
                paths = [steps(s["nodes"], k, n, levels_of(s["n"])) + s["path"] for k in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(s["ids"], pa.int64()), pa.array(paths, pa.binary())], names=[name, "path"])

    return extract


def _unfold(level: int):
    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                n, tree_n = leaves_of(s["run"], s["n"]), s["n"]
                tree, at, digest = [], [], []
                for height in range(1 if level else 0, levels_of(tree_n) + 1):
                    for k in range(-(-n >> height)):
                        place = DIGEST * position(height, k, n)
                        index = (s["run"] << (HEIGHT - height)) + k
                        tree.append(s["tree"])
                        at.append((height + level * HEIGHT, index))
                        digest.append(s["nodes"][place : place + DIGEST].hex())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree, pa.int64()), pa.array([h for h, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int64()), pa.array(digest)],
                    names=["tree", "height", "place", "digest"],
                )

    return unfold


@dataclass(frozen=True)
class Manifest:
    """Written logs of the trees and of the tree over their roots, the ways up, and the root."""

    log: list[DataFrame]
    top: list[DataFrame]
    segments: DataFrame
    root: bytes

    def proofs(self) -> DataFrame:
        """``PROOF``: each leaf with its proof's digest, and the root that its changed row (else its own) folds to."""
        return self.segments.mapInArrow(_prove(self.root), PROOF)

    def paths(self) -> DataFrame:
        """``doc_id`` and ``path``: a side (``L``, ``R``, ``-``) and 32 bytes for each level up to the root."""
        return self.segments.mapInArrow(_extract("doc_id"), "doc_id long, path binary")

    def nodes(self) -> DataFrame:
        """Every node of the trees: ``tree``, ``height``, ``place`` (within the level), ``digest``. ``position`` gives its place in the log."""
        out = None
        for level, segments in enumerate(self.log):
            found = segments.mapInArrow(_unfold(level), "tree long, height int, place long, digest string")
            out = found if out is None else out.union(found)
        return out


def build_manifest(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", tree_col: str = "lang",
    changed: dict[str, Column] | None = None, when: Column | None = None,
) -> Manifest | None:
    """A tree per value of ``tree_col`` over its rows by id, and a tree over their roots; None for an empty table.

    ``changed`` are columns as an intruder would leave them ``when`` a row is touched; proofs fold those rows instead.
    Every column may be null. Null ids come first in their tree, a null tree is the first; rows equal in tree and id are
    in order of their digest; equal rows are leaves of their own. Columns not in ``columns`` are ignored.
    """
    own = [F.col(f"`{c}`") for c in columns]
    other = [(changed or {}).get(c, F.col(f"`{c}`")) for c in columns]
    touched = F.when(when, leaf_digest(other)) if when is not None else F.lit(None).cast("binary")
    rows = docs.select(
        F.col(f"`{tree_col}`").cast("string").alias("tree_of"), F.col(f"`{id_col}`").cast("long").alias("id"),
        leaf_digest(own).alias("leaf"), touched.alias("changed"),
    )
    rows = saved(rows, "leaf-digests")
    if rows.isEmpty():
        return None
    log = append_log(ordered_leaves(rows))
    subroots = saved(roots(log), "subroots")
    over = ranked(subroots, ["tree"], "index").withColumn("n", F.lit(subroots.count()).cast("long"))
    top = append_log(
        over.select(F.lit(0).cast("long").alias("tree"), "n", "index", F.col("tree").alias("id"), F.col("subroot").alias("leaf"),
                    F.lit(None).cast("binary").alias("changed"))
    )
    root = bytes(roots(top).first()["subroot"])
    above = docs.sparkSession.createDataFrame([(0, b"", root)], "tree long, path binary, subroot binary")
    ways = with_paths(top, above).mapInArrow(_extract("tree"), "tree long, path binary")
    return Manifest(log, top, with_paths(log, saved(ways.join(subroots, "tree"), "manifest-tops")), root)
