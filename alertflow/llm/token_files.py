"""Flat token files: unsigned ids end to end, 64-bit document offsets, read through a memory map."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertflow.llm.common import SLICE, narrow, saved, shared_folder
from alertflow.llm.encode import encoder

VOCABULARY, END = "byte_bpe_50k.json", 2
PARTS = "part string, n_docs long, n_tokens long, dtype string"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, vocabulary: str, end: int, dtype: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One part: ids while they come, then lengths and document ids. A lost task writes its part anew."""
        store, base = _store(folder)
        stem, ids_file, lengths, docs = uuid.uuid4().hex, None, [], []
        tail = np.asarray([end], dtype).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                for raw in map(encoder(vocabulary).encode, piece.column("text").to_pylist()):
                    ids_file = ids_file or store.open_output_stream(f"{base}/{stem}.ids")
                    ids_file.write(np.frombuffer(raw, "<u4").astype(dtype).tobytes() + tail)
                    lengths.append(len(raw) // 4 + 1)
                docs.append(piece.column("doc_id"))
        if not lengths:
            return
        ids_file.close()
        with store.open_output_stream(f"{base}/{stem}.len") as out:
            out.write(np.asarray(lengths, "<u8").tobytes())
        with store.open_output_stream(f"{base}/{stem}.doc") as out:
            sink = pa.ipc.new_stream(out, pa.schema([("doc_id", pa.int64())]))
            for column in docs:
                sink.write_batch(pa.record_batch([column], names=["doc_id"]))
            sink.close()
        yield pa.RecordBatch.from_pydict(
            {"part": [stem], "n_docs": [len(lengths)], "n_tokens": [int(np.sum(lengths))], "dtype": [dtype]}
        )

    return write


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    end: int = END,
    vocabulary_size: int | None = None,
) -> DataFrame:
    """Encode every text and write the ids in ascending order of id; returns the index of the parts.

    Each part is ``<part>.ids`` (ids end to end, 16 bits wide where the vocabulary fits, else 32, little-endian),
    ``<part>.off`` (one 64-bit start per document and the end, counted over all parts) and ``<part>.doc`` (document
    ids). The index has a row per part in order, with ``base``, the ids of all parts before it. A part is written by one
    task while the rows come, so memory does not grow with it; a repeated attempt writes files of another name, and only
    those of the attempt that counted are in the index. Null texts are empty and hold only the end id; null ids come
    first, equal ids in order of their text; other columns are ignored; an empty table has no parts.
    """
    spark = docs.sparkSession
    if vocabulary_size is None:
        vocabulary_size = encoder(vocabulary).library.get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if max(vocabulary_size - 1, end) < 1 << 16 else "<u4"
    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    ordered = narrow(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    lowest = ordered.mapInArrow(_write(folder, vocabulary, end, dtype), PARTS).withColumn("at", F.spark_partition_id())
    parts = saved(lowest, "token-parts").orderBy("at").collect()  # a row per part, not per document
    base, index = 0, []
    for p in parts:
        index.append((p["part"], p["n_docs"], p["n_tokens"], p["dtype"], base))
        base += p["n_tokens"]
    frame = spark.createDataFrame(index, PARTS + ", base long")
    offsets = frame.repartition(max(1, len(index)), "part").mapInArrow(_offsets(folder), "part string")
    saved(offsets, "token-offsets")
    return frame


def _offsets(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Starts over all parts: the part's base plus the prefix sums of its lengths."""
        store, base = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['part']}.len") as f:
                    lengths = np.frombuffer(f.read(), "<u8")
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(row["base"])
                with store.open_output_stream(f"{base}/{row['part']}.off") as out:
                    out.write(starts.astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("part")], names=["part"])

    return write


class TokenPart:
    """A part's documents: ids through a memory map where the store is local, else by ranged reads."""

    def __init__(self, folder: str, part: str, dtype: str, base: int):
        store, root = _store(folder)
        self.dtype, self.base = np.dtype(dtype), base
        with store.open_input_file(f"{root}/{part}.off") as f:
            self.starts = np.frombuffer(f.read(), "<u8").astype(np.int64)
        with store.open_input_file(f"{root}/{part}.doc") as f:
            self.docs = pa.ipc.open_stream(f).read_all().column("doc_id")
        local = isinstance(store, fs.LocalFileSystem)
        self.ids = np.memmap(f"{root}/{part}.ids", self.dtype, "r") if local else None
        self.file = None if local else store.open_input_file(f"{root}/{part}.ids")

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, k: int) -> np.ndarray:
        low, high = (int(x) - self.base for x in self.starts[k : k + 2])
        if self.ids is not None:
            return self.ids[low:high]
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((high - low) * width, low * width), self.dtype)


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = TokenPart(folder, row["part"], row["dtype"], row["base"])
                crc = [zlib.crc32(part[k].astype("<u4").tobytes()) for k in range(len(part))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.docs.combine_chunks() if part.docs.num_chunks != 1 else part.docs.chunk(0),
                        pa.array(part.starts[:-1]),
                        pa.array(np.diff(part.starts)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """From the files: per document its start, number of ids and the CRC-32 of the ids as 32-bit integers."""
    n = max(1, index.count())
    return index.repartition(n, "part").mapInArrow(_read(folder), ROWS)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files beside the checkpoints."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    return folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") else f"file://{folder}"
