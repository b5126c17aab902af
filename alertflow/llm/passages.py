"""Substring deduplication: paragraph MinHash banding, and verbatim passages inside longer paragraphs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertflow.llm.common import SLICE, byte_rows, narrow, saved
from alertflow.llm.near import Scheme, Signer, near_components, pick

#: Words of a shingle and least words of a paragraph.
SHINGLE, LEAST_WORDS = 5, 32
#: Words of a passage that is compared verbatim, and positions among which one passage starts. Whatever text repeats
#: over PASSAGE + REACH - 1 = 50 words holds such a passage at the same place in every copy.
PASSAGE, REACH = 32, 19
#: High recall: a pair of paragraphs at similarity 0.8 shares one of the bands with 99.2 %, at 0.9 with more than 99.99 %.
SCHEME = Scheme(percent=80, rows=5, bands=12, bits=4, small_sets=True)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
SPOT = "kind string, doc_id long, start int, end int, node long, proof long, planes array<long>, keys array<long>"


class Text:
    """Words of a text with their places in its UTF-8 bytes, and a 64-bit hash of every run of SHINGLE words."""

    def __init__(self, raw: bytes):
        blank = np.ones(len(raw) + 2, bool)
        blank[1:-1] = BLANK[np.frombuffer(raw, np.uint8)]
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        self.raw, self.starts, self.ends = raw, edge[::2], edge[1::2]
        self.flat = flat = b" ".join(raw.lower().split())
        gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        self.begin, self.end = ([0, *(gaps + 1).tolist()], [*gaps.tolist(), len(flat)]) if flat else ([], [])
        of = xxhash.xxh3_64_digest
        # zip ends with the last whole shingle
        digests = b"".join([of(flat[a:b]) for a, b in zip(self.begin, self.end[SHINGLE - 1 :], strict=False)])
        self.hashes = np.frombuffer(digests, ">u8").astype(np.uint64)

    def __len__(self) -> int:
        return len(self.starts)

    def run(self, first: int, n: int) -> bytes:
        return self.flat[self.begin[first] : self.end[first + n - 1]]

    def paragraphs(self) -> list[tuple[int, int]]:
        """First word and number of words of what lies between blank lines, and of each line in it, if long enough."""
        before = np.searchsorted(self.starts, np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10)).tolist()
        at = sorted({0, len(self), *before})
        # a line without words leaves two breaks before the same word
        blank = sorted({0, len(self), *(y for x, y in pairwise(before) if x == y)})
        return sorted({(a, b - a) for cuts in (at, blank) for a, b in pairwise(cuts) if b - a >= LEAST_WORDS})

    def anchors(self) -> np.ndarray:
        """Words at which a passage starts: the least hash of every REACH neighbours, the first of equals."""
        n = len(self) - PASSAGE + 1
        if n < 1:
            return np.empty(0, np.int64)
        h = self.hashes[:n]
        if n < REACH:
            return np.asarray([int(h.argmin())])
        # a word is the least somewhere if the largest of the minima of the runs that hold it is its own hash
        least = _sliding(np.minimum, h)
        edge = np.zeros(REACH - 1, np.uint64)
        found = np.flatnonzero(_sliding(np.maximum, np.concatenate([edge, least, edge])) == h)
        chosen = h[found]
        if len(np.unique(chosen)) < len(chosen):
            # repeats: which of equals is the first depends on the run
            return np.unique(sliding_window_view(h, REACH).argmin(axis=1) + np.arange(n - REACH + 1))
        return found

    def set_of(self, first: int, n: int) -> np.ndarray:
        """Sorted distinct hashes of the shingles of ``n`` words."""
        x = np.sort(self.hashes[first : first + n - SHINGLE + 1])
        new = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=new[1:])
        return x[new]


def _sliding(of: np.ufunc, x: np.ndarray) -> np.ndarray:
    """``of`` over every REACH neighbours, in steps that double the run."""
    n = 1
    while 2 * n <= REACH:
        x, n = of(x[:-n], x[n:]), 2 * n
    rest = REACH - n
    return of(x[:-rest], x[rest:]) if rest else x


def _names(digests: list[bytes]) -> pa.Array:
    """64-bit digests as signed numbers, 2^63 less than the unsigned ones."""
    return pa.array((np.frombuffer(b"".join(digests), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64))


def _lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * np.int32(width), rows.reshape(-1))


def _spots(scheme: Scheme):
    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(scheme)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                sets: list[np.ndarray] = []
                found: dict[str, list[tuple]] = {"paragraph": [], "passage": []}
                for doc, raw in zip(piece.column("doc_id").to_pylist(), byte_rows(piece.column("text")), strict=True):
                    text = Text(bytes(raw))
                    spans = text.paragraphs()
                    sets += [text.set_of(first, n) for first, n in spans]
                    anchors = text.anchors().tolist()
                    for kind, places in (("paragraph", spans), ("passage", [(first, PASSAGE) for first in anchors])):
                        if places:
                            first = np.asarray([at for at, _ in places])
                            last = first + [n - 1 for _, n in places]
                            runs = [text.run(at, n) for at, n in places]
                            found[kind].append((doc, text.starts[first], text.ends[last], runs))
                for kind, texts in found.items():
                    if not texts:
                        continue
                    runs = [run for t in texts for run in t[3]]
                    docs = np.repeat(np.asarray([t[0] for t in texts], np.int64), [len(t[3]) for t in texts])
                    columns = [pa.array([kind]).take(pa.array(np.zeros(len(runs), np.int32))), pa.array(docs)]
                    columns += [pa.array(np.concatenate([t[k] for t in texts]).astype(np.int32)) for k in (1, 2)]
                    columns += [_names([xxhash.xxh3_64_digest(run) for run in runs]), _names([xxhash.xxh64_digest(run) for run in runs])]
                    if kind == "paragraph":
                        minima = signer.minima(sets)
                        columns += [_lists(signer.planes(minima)), _lists(signer.keys(minima))]
                    else:
                        columns += [pa.nulls(len(runs), pa.list_(pa.int64()))] * 2
                    yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SPOT.split(", ")])

    return spots


def _paragraph_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            names, sets = [], []
            for raw in byte_rows(batch.slice(at, SLICE).column("text")):
                text = Text(bytes(raw))
                for first, n in text.paragraphs():
                    names.append(xxhash.xxh3_64_digest(text.run(first, n)))
                    sets.append(text.set_of(first, n).view(np.int64))
            yield pa.RecordBatch.from_arrays([_names(names), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])


def _first_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups found in more than one document, with the place that stays: the smallest document, its first place.

    Of places that start there the longest stays; what lies inside it is no place of its own.
    """
    group = rows.groupBy(*by).agg(F.min("doc_id").alias("keep_doc"), F.max("doc_id").alias("high"))
    group = group.where(F.col("keep_doc") < F.col("high")).drop("high")
    here = rows.join(group, by)
    kept = here.where(F.col("doc_id") == F.col("keep_doc"))
    kept = kept.groupBy(*by).agg(F.min(F.struct("start", (-F.col("end")).alias("end"))).alias("kept"))
    kept = kept.select(*by, F.col("kept.start").alias("keep_start"), (-F.col("kept.end")).alias("keep_end"))
    inside = (F.col("doc_id") == F.col("keep_doc")) & (F.col("end") <= F.col("keep_end"))
    whole = (F.col("start") == F.col("keep_start")) & (F.col("end") == F.col("keep_end"))
    return here.join(kept, by).where(~inside | whole).drop("keep_end")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SCHEME) -> DataFrame:
    """Every place of a text that repeats in another document: one row per place, kept ones included.

    ``doc_id``, ``kind``, ``start`` and ``end`` (in the text's UTF-8 bytes), ``keep_doc`` and ``keep_start`` (the place
    that stays of its group), ``kept``.

    * ``paragraph``: the words between two blank lines, and each line, from 32 words on. Candidates share a MinHash band, links are confirmed on the full sets of
      5-word shingles (similarity 0.8 or more), groups are the components of the links.
    * ``passage``: verbatim runs (blanks and A-Z case aside) of 32 words or more anywhere in a text, also inside a
      paragraph or across lines. Passages start where the hash of the next words is least among 19 neighbours, which
      depends on the passage alone, so a text of 50 words or more that repeats has one in common with its copy.
      Neighbouring passages with the same distance to the place they keep are one row.

    Copies inside one document count only if another document has the text too. Null, empty and short texts have no
    rows; rows with a null id can't be named and are left out; rows that repeat an id are one document. Other columns
    are ignored. An empty table gives an empty result.
    """
    texts = narrow(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    spots = saved(texts.mapInArrow(_spots(scheme), SPOT), "spots", by="kind")

    lines = spots.where(F.col("kind") == "paragraph").drop("kind")
    names = lines.groupBy("node").agg(F.min("proof").alias("low"), F.max("proof").alias("high"), F.count("*").alias("weight"))
    clear = names.where(F.col("low") == F.col("high")).select("node", "weight")
    items = lines.select("node", "planes", "keys").dropDuplicates(["node"]).join(clear, "node")
    items = saved(items, "paragraphs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        nodes = saved(nodes, "nodes")
        holders = lines.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        sets = pick(texts, holders, "doc_id").mapInArrow(_paragraph_sets, "node long, set array<long>")
        return sets.join(nodes, "node", "left_semi").dropDuplicates(["node"])

    roots = near_components(items, sets_of, scheme)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    grouped = lines.select("doc_id", "start", "end", "node", "proof").join(roots, "node", "left")
    grouped = grouped.select(
        "doc_id", "start", "end", F.coalesce("root", "node").alias("group"),
        F.when(F.col("root").isNull(), F.col("proof")).otherwise(F.lit(0)).alias("proof"),
    )
    columns = ["doc_id", "kind", "start", "end", "keep_doc", "keep_start"]
    paragraphs = _first_of(grouped, ["group", "proof"]).withColumn("kind", F.lit("paragraph")).select(*columns)

    # most passages are found once: they go by their 64-bit name alone, the rest is then told apart by both
    places = spots.where(F.col("kind") == "passage").select("doc_id", "start", "end", "node", "proof")
    again = places.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    again = again.where(F.col("low") < F.col("high")).select("node")
    place = F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long"))
    places = places.select("doc_id", place.alias("place"), "node", "proof").join(again, "node")
    start, end = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    places = saved(places.select("doc_id", start.alias("start"), end.alias("end"), "node", "proof"), "repeats")
    places = saved(_first_of(places, ["node", "proof"]), "passages").withColumn("shift", F.col("start") - F.col("keep_start"))
    along = Window.partitionBy("doc_id", "keep_doc", "shift").orderBy("start")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    places = places.withColumn("fresh", (reached.isNull() | (F.col("start") > reached)).cast("int"))
    places = places.withColumn("island", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = places.groupBy("doc_id", "keep_doc", "shift", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("keep_start").alias("keep_start")
    )
    found = paragraphs.union(merged.withColumn("kind", F.lit("passage")).select(*columns))
    return found.withColumn("kept", (F.col("doc_id") == F.col("keep_doc")) & (F.col("start") == F.col("keep_start")))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for raw, spans in zip(byte_rows(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            raw, parts, at = bytes(raw), [], 0
            for span in sorted((s["start"], s["end"]) for s in spans or ()):
                if span[0] > at:
                    parts.append(raw[at : span[0]])
                at = max(at, span[1])
            out.append(b"".join([*parts, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of every document without the places that are not kept."""
    gone = passages.where(~F.col("kept")).groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = narrow(docs, id_col, text_col).join(gone, "doc_id", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_without, "doc_id long, text string")
