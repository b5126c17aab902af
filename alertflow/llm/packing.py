"""Packing of documents into fixed sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import SLICE, narrow, saved
from alertflow.llm.encode import encoder

VOCABULARY, END, LENGTH = "word_bpe_49k.json", 1, 2048
#: Documents that are packed together, on average. Larger groups waste less and take one task longer.
GROUP_DOCS, SEED = 4096, 7
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECE}, sequence_id long, offset long"


class Bins:
    """Bins in the order they were opened; the tree's root knows the largest capacity left, its leaves are the bins."""

    def __init__(self, size: int, most: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.tree = [size] * (2 * self.leaves)
        self.opened = 0

    def put(self, need: int) -> int:
        """The first bin with room for ``need``, which is taken from it."""
        at = 1
        while at < self.leaves:
            at *= 2
            at += self.tree[at] < need
        bin_ = at - self.leaves
        self.opened = max(self.opened, bin_ + 1)
        self.tree[at] -= need
        while at > 1:
            at //= 2
            self.tree[at] = max(self.tree[2 * at], self.tree[2 * at + 1])
        return bin_


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset in it of each piece; pieces are placed from long to short, equal ones in the given order."""
    bins, used = Bins(size, max(1, len(lengths))), {}
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        b = bins.put(need := int(lengths[k]))
        where[k], offset[k] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + need
    return where, offset


def _cut(vocabulary: str, end: int, size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.asarray([end], "<u4").tobytes()
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row", "ids")}
                texts = map(encoder(vocabulary).encode, piece.column("text").to_pylist())
                for doc, raw in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
                    raw += tail
                    row += 1
                    for low in range(0, len(raw), 4 * size):
                        part = raw[low : low + 4 * size]
                        values = (doc, low // 4, len(part) // 4, zlib.crc32(part), len(raw) // 4, row, part)
                        for column, value in zip(out.values(), values, strict=True):
                            column.append(value)
                types = [pa.int64()] * 6 + [pa.binary()]
                columns = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=list(out))

    return cut


def token_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end: int = END,
    size: int = LENGTH,
) -> DataFrame:
    """Each text's ids and the end id, cut into pieces of ``size`` and a rest; ``ids`` has them, little-endian 32 bits.

    ``row`` numbers the input rows, so that rows equal in id and text are told apart.
    """
    return narrow(docs, id_col, text_col).mapInArrow(_cut(vocabulary, end, size), f"{PIECE}, row long, ids binary")


def _pack(size: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")])
        bins, offset = first_fit_decreasing(table.column("length").to_numpy(), size)
        ids = bins + (table.column("group").to_numpy().astype(np.int64) << 32)
        return table.drop_columns(["group", "row"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    return pack


def pack_pieces(pieces: DataFrame, n_docs: int, size: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Place pieces into sequences: documents are dealt into groups by a hash of id and row, each packed on its own.

    A group has about ``group_docs`` documents whatever the table holds, also where most rows are equal, so its task and
    its tree stay small. The pieces of a document are one group's. Sequence
    ids are the group's number and the bin's. Only lengths and names travel, no ids.
    """
    groups = max(1, -(-n_docs // group_docs))
    group = F.pmod(F.xxhash64("doc_id", "row", F.lit(SEED)), F.lit(groups))
    return pieces.withColumn("group", group).groupBy("group").applyInArrow(_pack(size), PLACED)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end: int = END,
    size: int = LENGTH,
    group_docs: int = GROUP_DOCS,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset; every id lies in exactly one piece.

    Long documents fill whole sequences; their rests and the short documents are placed first-fit decreasing. A null or
    empty text is its end id alone. Null and repeated ids are packed like others. Other columns are ignored. An empty
    table gives no pieces. Within a sequence offsets are gapless from 0; what is left of ``size`` is padding.
    """
    pieces = token_pieces(docs, id_col, text_col, vocabulary, end, size).drop("ids")
    pieces = saved(pieces, "pieces")
    n_docs = pieces.where(F.col("start") == 0).count()
    return pack_pieces(pieces, n_docs, size, group_docs)
