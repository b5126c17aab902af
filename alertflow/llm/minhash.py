"""Near-duplicate documents by b-bit MinHash over word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertflow.llm.common import SLICE, byte_rows, narrow, saved
from alertflow.llm.near import Scheme, Signer, near_components, pick, shingle_hashes

#: Words in a shingle; the scheme's 85 hundredths is the least similarity of a link.
SHINGLE = 5
#: 336 minima are in bands; 512 make the estimate sharp enough to give up pairs below 0.76 (at 5.5 deviations).
MINIMA = 512
SCHEME = Scheme(minima=MINIMA)


def _sets(batch: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    # bytes.lower and bytes.split know ASCII only: A-Z, and space and tab to carriage return
    return [shingle_hashes(bytes(raw).lower().split(), shingle) for raw in byte_rows(batch.column("text"))]


def _sign(scheme: Scheme, shingle: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(scheme)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                sets = _sets(piece, shingle)
                full = [k for k, s in enumerate(sets) if len(s)]
                names: list = [None] * len(sets)
                planes, keys = list(names), list(names)
                if full:
                    minima = signer.minima([sets[k] for k in full])
                    for k, p, q in zip(full, signer.planes(minima), signer.keys(minima), strict=True):
                        names[k], planes[k], keys[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), p, q
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(names, pa.binary()),
                        pa.array(planes, pa.list_(pa.int64())),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_hash", "planes", "keys"],
                )

    return sign


def signatures(docs: DataFrame, id_col: str, text_col: str, scheme: Scheme = SCHEME, shingle: int = SHINGLE) -> DataFrame:
    """Set size, a 128-bit name of the set, packed low bits and band keys of every document, in one pass."""
    schema = "doc_id long, n_shingles long, set_hash binary, planes array<long>, keys array<long>"
    return narrow(docs, id_col, text_col).mapInArrow(_sign(scheme, shingle), schema)


def _emit_sets(shingle: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                sets = pa.array([s.view(np.int64) for s in _sets(piece, shingle)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), sets], names=["node", "set"])

    return emit


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SCHEME, shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of word shingles; a document of
    fewer words has its whole sequence as one shingle. ``component_id`` is the smallest id it can reach over links.

    Equal sets are one class and take part once, through their smallest id, so a group of exact copies costs a row per
    task. A null, empty or blank text has no set and is linked with nothing. A row with a null id is returned with a
    null component and kept, and links nothing. Rows that repeat an id are all returned, each judged by its own text; a
    link of one of their texts is a link of the id. Other columns are ignored. An empty table gives an empty result.
    """
    rows = saved(signatures(docs, id_col, text_col, scheme, shingle), "signatures")
    with_set = rows.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = saved(with_set.groupBy("set_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("weight")), "classes")
    items = with_set.join(classes, ["doc_id", "set_hash"]).dropDuplicates(["doc_id", "set_hash"])
    items = saved(items.select(F.col("doc_id").alias("node"), "weight", "planes", "keys"), "items")
    texts = narrow(docs, id_col, text_col)

    def sets_of(nodes: DataFrame) -> DataFrame:
        return pick(texts, nodes, "doc_id").mapInArrow(_emit_sets(shingle), "node long, set array<long>")

    roots = near_components(items, sets_of, scheme)
    # ids repeated with other texts: the classes of one id are one node
    found = classes.drop("weight").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    found = found.select("set_hash", F.coalesce("root", "doc_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_hash")
    linked = out.join(found, "set_hash").select("doc_id", "n_shingles", "component_id")
    linked = linked.where(F.col("doc_id").isNotNull())
    lone = out.where(F.col("set_hash").isNull() | F.col("doc_id").isNull())
    lone = lone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    whole = linked.union(lone)
    return whole.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with all columns, without documents that another of their group stands for.

    The document with the smallest id of a group stays. Rows with a null id or without words stay. Rows that repeat the
    id of a document that stays all stay, as their texts are exact or near copies that the id itself stands for.
    """
    found = near_duplicates(docs, id_col, text_col, Scheme(percent=percent, minima=MINIMA))
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    return rows.join(gone, F.col(f"d.`{id_col}`").cast("long") == F.col("gone_id"), "left_anti").select("d.*")
