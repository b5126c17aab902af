"""Exact deduplication by a tree-merge of sorted digest runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import byte_rows, narrow, saved

#: Runs that meet in one slot in each round, and the number of rounds; there are FAN_IN ** ROUNDS slots.
FAN_IN, ROUNDS = 16, 2
BLANKS = b" \t\n\x0b\x0c\r"
KEY = ["digest", "proof", "n_bytes"]
RUN = "slot int, digest binary, proof long, n_bytes long, points long, doc_id long, group_size long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha, proof, size = [], [], []
        for raw in byte_rows(batch.column("text")):
            bare = bytes(raw).translate(None, BLANKS)
            sha.append(hashlib.sha256(bare).digest())
            proof.append(xxhash.xxh3_64_intdigest(bare) - (1 << 63))
            size.append(len(bare))
        points = pc.cast(pc.utf8_length(batch.column("text")), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sha, pa.binary()), pa.array(proof, pa.int64()), pa.array(size, pa.int64()), points],
            names=["doc_id", *KEY, "points"],
        )


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, SHA-256 of the text without blanks, a second hash and the length as proof, code points of the text."""
    schema = "doc_id long, digest binary, proof long, n_bytes long, points long"
    return narrow(docs, id_col, text_col).mapInArrow(_digest, schema)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry per text of a sorted stream of runs: its first row, which is the best, and the sum of the sizes."""
    last: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table.cast(pa.schema([f.with_nullable(True) for f in table.schema]))
        table = table if last is None else pa.concat_tables([last, table])
        differs = np.zeros(table.num_rows, bool)
        differs[0] = True
        for name in ("slot", *KEY):
            column = table.column(name)
            differs[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy()
        first = np.flatnonzero(differs)
        sizes = np.add.reduceat(table.column("group_size").to_numpy(), first)
        table = table.take(pa.array(first)).set_column(
            table.schema.get_field_index("group_size"), "group_size", pa.array(sizes)
        )
        last = table.slice(table.num_rows - 1)
        yield from table.slice(0, table.num_rows - 1).to_batches()
    if last is not None:
        yield from last.to_batches()


def _merged(runs: DataFrame) -> DataFrame:
    order = ["slot", *KEY, F.col("points").desc(), F.col("doc_id").asc_nulls_last()]
    return runs.sortWithinPartitions(*order).mapInArrow(_merge, RUN)


def merge_runs(digest_rows: DataFrame, fan_in: int = FAN_IN, rounds: int = ROUNDS) -> DataFrame:
    """The document that stays of each text: ``digest``, ``proof``, ``n_bytes``, ``doc_id``, ``points``, ``group_size``.

    Every partition makes a sorted run without repeats. In round r, the ``fan_in`` slots that differ only in digit r
    exchange: each keeps the part of the digests with its own digit and merges the runs it gets. After the last round
    a slot holds the whole truth about its digests and about nothing else. A text that a third of the rows share is one
    entry per run from the start, so no slot ever sees more than ``fan_in`` entries of it a round.
    """
    slots = fan_in**rounds
    runs = digest_rows.select(
        F.pmod(F.spark_partition_id(), F.lit(slots)).alias("slot"), *KEY, "points", "doc_id", F.lit(1).cast("long").alias("group_size")
    )
    runs = _merged(runs)
    prefix = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
    for r in range(rounds):
        unit = fan_in**r
        mine, wanted = (F.floor(x / unit) % fan_in for x in (F.col("slot"), prefix))
        runs = runs.withColumn("slot", (F.col("slot") + (wanted - mine) * unit).cast("int"))
        runs = _merged(runs.repartition("slot"))
    return runs.drop("slot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: which document stays of those with an equal text.

    Texts are equal when they agree after deleting blanks (space, tab to carriage return). Of equal texts the one with
    the most code points stays, then the smallest id. A null text counts as empty and all empty texts are one group.
    A null id loses every tie and is returned; if it is alone, ``keep_id`` is null and it is kept. Rows that repeat an
    id and its text share one verdict. Other columns are ignored. An empty table gives an empty result.
    """
    rows = saved(digests(docs, id_col, text_col), "digests")
    best = merge_runs(rows).select(
        *KEY, F.col("doc_id").alias("keep_id"), F.col("points").alias("keep_points"), "group_size"
    )
    return rows.join(best, KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
